"""The whole write path against a painter of its own, a round that runs again, and entries nobody may trust."""

import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.text import DIM_OFF, DIM_ON, STOPWORDS
from foliant.operators import layout, raster, rounds
from foliant.sources import frames, png
from foliant.streaming.index import ArchiveIndex

KEY = bytes(range(32))
LOOKS = [rounds.Look("plain", raster.Sheet(8, 8, 64), raster.Sheet(4, 8, 64)), rounds.Look("dimmed", raster.Sheet(8, 8, 64, ink="sent"), raster.Sheet(4, 8, 64, ink="sent"), True)]
SCHEMA = "conv_id long, first_kept string, text string, summary string, files string, look string"
CAPACITY = 8 * 7


def request(conv_id, text, look="plain"):
    return (conv_id, "entry", text, None, None, look)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(["the", "of", "alpha.", "beta", "gamma!", "delta"], n))


def stored(root) -> dict[str, bytes]:
    return {f"{d}/{f}": open(f"{root}/{d}/{f}", "rb").read() for d in os.listdir(root) for f in os.listdir(f"{root}/{d}")} if os.path.isdir(root) else {}


@pytest.fixture
def archiver(spark, tmp_path):
    index = ArchiveIndex(spark, str(tmp_path / "index"), KEY)

    def run(rows, batch, looks=LOOKS):
        asked = spark.createDataFrame(rows, SCHEMA)
        rounds.archive_round(asked, looks, raster.test_glyphs(), index, str(tmp_path / "frames"), batch=batch, ts=batch, most=5)
        return {r["conv_id"]: r for r in index.live().collect()}

    return run, index, str(tmp_path / "frames")


def test_images_are_those_of_the_pages(spark, archiver):
    run, _, root = archiver
    text = words(60, 1)
    live = run([request(1, text), request(2, text, "dimmed"), request(3, "short"), request(4, None)], 0)
    assert sorted(live) == [1, 2, 3] and not live[3]["frames"] and live[3]["frames_dir"] is None
    middle = text[CAPACITY : len(text) - CAPACITY]
    pages = [middle[i : i + CAPACITY] for i in range(0, len(middle), CAPACITY)]
    assert len(pages) > 2
    for conv_id, look in ((1, LOOKS[0]), (2, LOOKS[1])):
        found = [png.decode(stored(root)[f"{live[conv_id]['frames_dir']}/{f['file']}"]) for f in live[conv_id]["frames"]]
        painter = raster.Painter(look.high, raster.test_glyphs())
        for i, (page, pixels) in enumerate(zip(pages, found, strict=True)):
            if look.dim:  # as whole words of the page
                page = "".join(f"{DIM_ON}{w}{DIM_OFF}" if w.lower() in STOPWORDS else w for w in re.split(r"(\W+)", page))
            expected, n = painter.page(page, layout.BANNER % (i + 1, len(pages)))
            assert np.array_equal(pixels, expected) and n == live[conv_id]["frames"][i]["chars"]


def test_rounds_add_up_and_a_repeated_one_changes_nothing(spark, archiver):
    run, index, root = archiver
    first, second = words(30, 2), words(30, 3)
    run([request(1, first), request(2, first)], 0)
    old = stored(root)
    live = run([request(1, second)], 1)
    assert live[1]["text"] == f"{first}█{second}" and live[2]["text"] == first
    after = stored(root)
    assert {name.split("/")[0] for name in after} == {live[c]["frames_dir"] for c in (1, 2)}  # the folder of the older archive went
    assert any(name not in after for name in old) and all(hashlib.sha256(b).hexdigest() + ".png" == name.split("/")[1] for name, b in after.items())
    again = run([request(1, second)], 1)
    assert again == live and stored(root) == after
    assert {(r["frames_dir"], r["file"]) for r in frames.read(spark, root).collect()} == {tuple(n.split("/")) for n in after}


def test_changed_entries_are_not_built_on(spark, archiver):
    run, index, root = archiver
    run([request(1, "first words")], 0)
    path = f"{index.root}/batch=0"
    changed = [tuple(r) for r in spark.read.parquet(path).withColumn("text", F.lit("other words")).drop("trusted").collect()]
    schema = spark.read.parquet(path).drop("trusted").schema
    index.upsert(spark.createDataFrame(changed, schema), 0)
    live = run([request(1, "second words")], 1)
    assert live[1]["text"] == "second words" and {r["conv_id"]: r["rejected"] for r in index.rejected().collect()} == {1: 1}


def test_unknown_look_and_no_requests(spark, archiver):
    run, index, root = archiver
    assert run([], 0) == {} and stored(root) == {}
    for look in ("no such", None):
        with pytest.raises(Exception, match="unknown look"):
            run([request(1, words(60, 4), look)], 1)
    assert stored(root) == {} and index.live().count() == 0
