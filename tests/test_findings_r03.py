"""What larger tables showed and the smallest ones do not."""

import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.text import CELL, DIM_OFF, DIM_ON, normalize_latin
from foliant.operators import archive, raster
from foliant.plans import catalog
from foliant.session import spread
from foliant.sources import frames, png
from tests.test_catalog import comparable

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["frame_slots", "rebuild_mixed"])
def test_missing_file_is_missing_beside_an_equal_text(spark, tmp_path, name):
    """Documents 1 and 6 of a dozen are stored, 3, 5 and 8 are not: equal texts must not stand in for each other."""
    texts = {1: "same", 3: "same", 5: None, 6: None, 8: "same"}
    rows = [(i, texts.get(i % 12, f"text {i}"), "en", "web", 0) for i in range(24)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES[name](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = connection.sql(catalog.ORACLE_SQL[name])
    assert comparable([tuple(r) for r in found.collect()], found.columns) == comparable(expected.fetchall(), expected.columns)


def plainly_painted(text, banner, sheet, glyphs):
    """A page by one blend after another."""
    painter, cells = raster.Painter(sheet, glyphs), raster.placed(text, sheet)
    used = max((row for _, _, row, _ in cells), default=0) + 1
    canvas = np.full(((1 + used * sheet.repeat) * sheet.cell_h, sheet.size, 3), 255, np.uint8)

    def put(ch, x, y, ink):
        if (found := painter.shape(ord(ch))) is not None:
            raster.blend(canvas, found[0], x + found[1], y + found[2], ink)

    for i, ch in enumerate(banner[: sheet.size // sheet.cell_w]):
        if 32 <= ord(ch) < 127:
            put(ch, i * sheet.cell_w, 0, raster.BLACK)
    for row in range(used if sheet.repeat > 1 else 0):
        canvas[(2 + row * sheet.repeat) * sheet.cell_h : (1 + (row + 1) * sheet.repeat) * sheet.cell_h] = raster.BAND
    for ch, col, row, ink in cells:
        for copy in range(sheet.repeat):
            put(ch, col * sheet.cell_w, (1 + row * sheet.repeat + copy) * sheet.cell_h, ink)
    return canvas, len(cells)


def test_pages_painted_by_arrays():
    """Glyphs of any size that overlap, marks, wide characters, copies, columns and both ways of scaling."""
    rng, texts = random.Random(1), [f"abc. !?z{CELL}{DIM_ON}{DIM_OFF}\n", f"ab. 日界é {CELL}{DIM_ON}{DIM_OFF}"]
    odd = {cp: (rng.choice([5, 8, 9]), rng.randint(1, 12), rng.randint(-3, 4), rng.randint(-3, 3), [rng.randint(0, 255) for _ in range(12)]) for cp in (*range(32, 256), ord("日"))}
    for k in range(300):
        text = "".join(rng.choice(texts[k % 2]) for _ in range(rng.choice([0, 1, 60, 200])))
        sheet = raster.Sheet(rng.choice([4, 8, 11]), rng.choice([5, 8, 16]), rng.choice([64, 120]), rng.choice([1, 2, 3]), rng.choice(["bw", "sent"]), rng.choice([1, 2]), k % 3 == 0, rng.choice([None, 7]))
        expected, n = plainly_painted(text, "PAGE 1 é OF 2", sheet, odd)
        image, height, printed = raster.Painter(sheet, odd).image(text, "PAGE 1 é OF 2")
        assert np.array_equal(png.decode(image), expected) and (height, printed) == (len(expected), n)


def test_few_colours_take_few_bits():
    rng = np.random.default_rng(1)
    for colours, depth in ((1, 1), (2, 1), (3, 2), (16, 4), (17, 8), (256, 8)):
        palette = np.arange(colours * 3, dtype=np.uint16).reshape(-1, 3).astype(np.uint8)
        pixels = palette[np.concatenate([np.arange(colours), rng.integers(0, colours, 77 * 5 - colours)]).reshape(5, 77)]
        image = png.encode(pixels)
        assert image[24] == depth and np.array_equal(png.decode(image), pixels)
        assert struct.unpack(">II", image[16:24]) == (77, 5)


def test_files_are_looked_up_by_the_rows_that_name_them(spark, tmp_path):
    name = archive.file_name(F.lit(b"one"))
    folder = tmp_path / "archive-frames-1"
    folder.mkdir()
    rows = spark.range(1).select(F.explode(F.array(name, F.lit("0" * 64 + ".png"), F.lit("../own"))).alias("file")).withColumn("frames_dir", F.lit("archive-frames-1"))
    good = rows.first()["file"]
    (folder / good).write_bytes(b"one")
    (folder / ("0" * 64 + ".png")).write_bytes(b"changed")
    assert [r["file"] for r in frames.present(rows, str(tmp_path)).collect()] == [good]
    (folder / good).unlink()
    assert frames.present(rows, str(tmp_path)).count() == 0


def test_few_bytes_are_spread_over_all_cores(spark):
    small = spark.range(0, 1000, 1, 1).selectExpr("id % 100 AS k").groupBy("k").count()
    assert spread(small, "k").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_normal_form_around_signs_and_runs(spark):
    """Signs only in an escape code change nothing, runs of lost characters go together, and spaces meet."""
    texts = ["a  b\n c ✅", "\x1b]title ✅ …\x07x – y  日本 z", "  ", "…", "a\u200b \u200b日 日 b", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", normalize_latin(F.col("text")).alias("t")).orderBy("id")
    assert [r["t"] for r in found.collect()] == [f"a b{CELL}c [OK]", "x - y z", "", "...", "a b", None]


def python_calls(run) -> int:
    """How many Python functions ``run`` calls."""
    import sys

    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event == "call" else None)
    try:
        run()
    finally:
        sys.setprofile(None)
    return len(calls)


def test_normalizing_costs_no_step_a_word():
    from foliant.functions.unicode import normalize

    text = "日 " + "some words of a text " * 1000
    assert python_calls(lambda: normalize(text, frozenset(), {})) < 100
    assert normalize(text, frozenset(), {}) == ("? " + ("some words of a text " * 1000).rstrip(), len(text) - 1, 1)


def test_texts_leave_arrow_in_blocks():
    import pyarrow as pa

    from foliant.functions.batches import BLOCK, in_blocks

    sizes = []
    texts = pa.array(["x" * 1000, None] * 5000)
    found = in_blocks(lambda part, n: (sizes.append(part.nbytes), part)[1], texts, texts)
    assert found.equals(texts) and max(sizes) <= 1.2 * BLOCK and len(sizes) > 1
    assert len(in_blocks(lambda part: part, pa.array([], pa.string()))) == 0


def test_pages_cost_no_step_a_character():
    from foliant.functions.cells import cut_pages

    plain, wide = "some words " * 1000, "日本 words " * 1000
    assert python_calls(lambda: cut_pages(plain, 50, 10, True)) < 10
    assert "".join(cut_pages(plain, 50, 10, True)) == plain
    assert python_calls(lambda: cut_pages(wide, 500, 10, True)) < len(wide) / 2
    assert "".join(cut_pages(wide, 50, 10, True)) == wide


def test_pages_are_those_of_a_walk_over_the_cells():
    from foliant.functions.cells import cut_pages

    def walk(text, capacity, cols):
        pages, page, cursor = [], "", 0
        for ch in text:
            width = 0 if ch in DIM_ON + DIM_OFF else 2 if ch in "日本語" else 1
            pad = width == 2 and cols >= 2 and cursor % cols == cols - 1
            if width and cursor and cursor + pad + width > capacity:
                pages.append(page)
                page, cursor, pad = "", 0, 0
            page, cursor = page + ch, cursor + pad + width
        return [*pages, page] if cursor else pages

    draw = random.Random(11)
    for _ in range(3000):
        text = "".join(draw.choice("ab日本語" + DIM_ON + DIM_OFF) for _ in range(draw.randrange(40)))
        capacity, cols = draw.randrange(1, 25), draw.randrange(1, 9)
        assert cut_pages(text, capacity, cols, True) == walk(text, capacity, cols)


def test_one_worker_normalizes_texts_and_digests(spark):
    from foliant.operators import writing

    previous = F.lit(None).cast("struct<text:string,text_head:string,text_tail:string,truncated_chars:bigint>")
    asked = spark.createDataFrame([("日 new", "日 old")], "text string, summary string").withColumn("previous", previous)
    made = writing.joined(asked)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert made.first()["archive_text"] == "[Digest of earlier history] ? old [Recent conversation] ? new"


def test_arguments_are_parsed_once(spark):
    """Kinds of values stand beside them in the plan, no lambda parses the text anew for each of them."""
    from foliant.operators import transcript

    given = '{"t": "a \\"b\\" [c]", "n": 7, "s": "7", "none": null, "o": {"z": 1, "a": ["]"]}, "e": ""}'
    made = spark.createDataFrame([(given,)], "t string").select(transcript.arguments(F.col("t")).alias("a"))
    assert [(r["k"], r["v_json"]) for r in made.first()["a"]] == [("t", '"a \\"b\\" [c]"'), ("n", "7"), ("s", '"7"'), ("none", "null"), ("o", '{"z":1,"a":["]"]}'), ("e", '""')]
    shown = made._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in shown.split("lambdafunction", 1)[1]


def test_state_takes_rows_and_one_look():
    """The rounds of a key are rows, no frame of their own, and its state is read once."""
    from pyspark.sql import Row

    from foliant.streaming.refold import Refold

    class State:
        value, looks = None, 0

        def get(self):
            self.looks += 1
            return self.value

        def update(self, value):
            self.value = value

    folding = Refold(160, 220, 11)
    folding.archive = State()
    first = list(folding.handleInputRows((5,), iter([Row(conv_id=5, round=1, text="b"), Row(conv_id=5, round=0, text="a")]), None))
    second = list(folding.handleInputRows((5,), iter([Row(conv_id=5, round=2, text=None)]), None))
    assert [tuple(r) for r in first + second] == [(5, 2, f"a{CELL}b", 0), (5, 3, f"a{CELL}b", 0)]
    assert folding.archive.looks == 2 and folding.archive.value == (f"a{CELL}b", 0, 3)
