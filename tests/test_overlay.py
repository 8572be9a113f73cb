"""Settings in columns against the function for one configuration."""

import json
import random

from pyspark.sql import functions as F

from foliant import options


def test_overlay(spark):
    rng = random.Random(3)
    values = {"enabled": [True, False, "no", None, 0], "dim_results": [True, False, 1], "shape": ["a", "b", "auto", 5, None, {}], "max_frames": [0.5, 1, 7.9, 500, -3, "9", True, None, [1], 10**30], "max_frame_bytes": [1, 1e12, 1e-9, {}]}
    layers = [({k: rng.choice(v) for k, v in values.items() if rng.random() < 0.5}, {k: rng.choice(v) for k, v in values.items() if rng.random() < 0.4}) for _ in range(300)]
    broken = [(None, ""), ("[1]", "5"), ('"x"', "null"), ('{"shape": "a"', None), ('{"max_frames": 4}', "{")]
    texts = [(json.dumps(a), json.dumps(b)) for a, b in layers] + broken
    wanted = [options.resolve([a, b], {}, {"a", "b"}) for a, b in layers] + [options.resolve([x], {}, {"a", "b"}) for x in ({}, {}, {}, {}, {"max_frames": 4})]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, far string, near string")
    found = {r["id"]: r["o"].asDict() for r in rows.select("id", options.overlay([F.col("far"), F.col("near")], {"a", "b"}).alias("o")).collect()}
    for i, one in enumerate(wanted):
        assert found[i] == {name: getattr(one, name) for name in found[i]}, texts[i]
