"""Behaviour of the scalar functions, cells, shapes, options, images and folds on literal cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant import options
from foliant.functions import cells, shapes
from foliant.functions import text as T
from foliant.operators import archive, raster, transcript
from foliant.sources import fonts, png
from foliant.streaming import refold


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "given_text", "expected"),
    [
        (lambda c: T.truncate_middle(c, 40, 0.6), "a" * 100, "a" * 24 + " […60ch elided…] " + "a" * 16),
        (T.elide_data_urls, "data:image/png;base64,abc", "data:image/png;base64,abc"),
        (lambda c: T.elide_data_urls(c, every=True), "data:image/png;base64,abc", "[data URL omitted: image/png, 3 base64 chars]"),
        (T.strip_marks, "evil \u000e injection", "evil  injection"),
        (T.collapse_space, "a  b\n\n\nc", "a b█c"),
        (T.collapse_space, "​ a​b c ​", "ab c"),
        (T.normalize_latin, "“a” → b …", '"a" -> b ...'),
        (T.normalize_latin, "tests ✅ done", "tests [OK] done"),
        (T.dim_stopwords, "the quick fox", "\u000ethe\u000f quick fox"),
        (T.dim_stopwords, "\u000eof the\u000f the", "\u000eof the\u000f \u000ethe\u000f"),
        (T.strip_thinking, "»user:a\n\n»think:x\n\n»ai:b", "»user:a\n\n»ai:b"),
        (T.strip_ansi, "\u001b[1mx\u001b[0m", "x"),
    ],
)
def test_text(spark, function, given_text, expected):
    assert value(spark, function(F.lit(given_text))) == expected


def test_cells(spark):
    assert value(spark, cells.cell_length(F.lit("ab日c"))) == 5
    assert value(spark, cells.cell_length(F.lit("ab日c"), False)) == 4
    assert value(spark, cells.narrow_pages(F.lit("abcdef"), F.lit(3))) == ["abc", "def"]
    assert cells.cut_pages("ab日cd", 4, 2, True) == ["ab日", "cd"]
    assert cells.cut_pages(T.DIM_ON, 4, 2, True) == []
    assert cells.wrap_lines("one two three four", 8, False) == ["one two", "three", "four"]
    assert cells.wrap_lines("abcdefghij", 4, False) == ["abcd", "efgh", "ij"]


@settings(max_examples=100, deadline=None)
@given(st.text("ab \u000e日", max_size=60), st.integers(2, 12))
def test_pages_join_to_the_text(text, capacity):
    pages = cells.cut_pages(text, capacity, 2, True)
    assert "".join(pages) == (text if any(c not in T.MARKS for c in text) else "")


def test_shapes(spark):
    readers = [("google-ai", "claude-fable", None), ("anthropic-x", "claude-opus-4-20250514", None), (None, None, "nonsense"), ("openai", "x", "doc-8on16-bw")]
    rows = shapes.grid(shapes.for_reader(spark.createDataFrame(readers, "api string, model_id string, forced string"))).withColumn("tokens", shapes.frame_tokens(F.col("family"), F.col("frame_size"))).collect()
    found = {(r["api"], r["model_id"]): (r["variant"], r["frame_size"], r["capacity"], r["tokens"]) for r in rows}
    assert found[("google-ai", "claude-fable")] == ("11on16-bw", 1932, 20825, 1120)
    assert found[("anthropic-x", "claude-opus-4-20250514")] == ("11on16-bw", 1568, 13774, 3293)
    assert found[(None, None)] == ("8on22-bw", 1568, 13720, 3293)
    assert found[("openai", "x")] == ("doc-8on16-bw", 1568, 18624, 2882)


def test_sections_keep_line_breaks(spark):
    rows = [(1, 0, "user", "a\n"), (1, 1, "user", "b"), (1, 2, "assistant", " \u000e "), (1, 3, "user", "\u000e"), (1, 4, "assistant", "c"), (2, 0, "system", "x")]
    found = transcript.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["text"]) for r in found] == [(1, "»user:a\nb\n\n\n»ai:c")]


def test_budget_goes_on_after_a_frame_that_does_not_fit(spark):
    sizes = F.array(*[F.lit(n).cast("long") for n in (100, 60, 40, 30)])
    assert value(spark, archive.within_budget(sizes, 150)) == [False, True, True, True]
    assert value(spark, archive.within_budget(F.array(*[F.lit(n).cast("long") for n in (100, 60, 140, 40)]), 150)) == [False, True, False, True]


def test_signatures_notice_every_change(spark):
    import hashlib
    import hmac

    key = b"k" * 32
    signed = archive.sign(spark.createDataFrame([(1, "a")], "conv_id long, text string"), key)
    row = signed.first()
    assert row["mac"] == hmac.new(key, b'{"conv_id":1,"text":"a"}', hashlib.sha256).hexdigest()
    changed = signed.withColumn("text", F.lit("b"))
    assert not changed.select(archive.verified(changed, key)).first()[0]
    assert signed.select(archive.verified(signed, key)).first()[0]


@pytest.mark.parametrize("name", ["archive-frames-1", "archive-frames-1234567890123456"])
def test_directory_names(spark, name):
    assert value(spark, archive.is_dir_name(F.lit(name)))
    assert not value(spark, archive.is_dir_name(F.lit(name + "\n"))) and not value(spark, archive.is_dir_name(F.lit("../" + name)))


def test_options():
    asked = [{"max_frames": 500, "shape": "x"}, {"max_frames": 9.7, "enabled": "no", "max_frame_bytes": -5}]
    assert options.resolve(asked, {}, {"x"}) == options.Options(shape="x", max_frames=9)
    assert options.resolve(asked, {"FOLIANT_MAX_FRAMES": "12abc", "FOLIANT_ENABLED": "off"}, {"x"}).max_frames == 12
    assert [options.bounded(v, 80) for v in ("80", None, True, float("nan"), float("inf"), 0, -5, 81)] == [None] * 7 + [80]


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for pixels in (rng.integers(0, 2, (4, 4, 3)).astype(np.uint8) * 255, rng.integers(0, 256, (40, 30, 3)).astype(np.uint8)):
        assert (png.decode(png.encode(pixels)) == pixels).all()


def test_raster():
    canvas, n = raster.paint("ab█c", raster.test_glyphs(), 8, 8, 32)
    assert n == 4 and canvas.shape == (16, 32, 3) and (canvas[8:, 16:24] == 0).all()
    with pytest.raises(ValueError):
        raster.paint("a", {}, 8, 8, 0)


def test_fonts(spark, tmp_path):
    (tmp_path / "a.hex").write_text("0041:0102030405060708\nbad\n00E9:FF00000000000000\n")
    rows = {r["cp"]: r["rows"] for r in fonts.read_hex(spark, str(tmp_path / "a.hex"), "f").collect()}
    assert rows == {0x41: [1, 2, 3, 4, 5, 6, 7, 8], 0xE9: [255] + [0] * 7}
    assert fonts.parse_bdf("ENCODING 65\nBBX 9 2 0 -1\nBITMAP\nF0\nzz\nENDCHAR\n") == [(65, 8, 2, 0, -1, [240, 0])]


def test_fold_by_batch_and_stream_agree(spark, tmp_path):
    rows = [(c, r, f"{c}{r}" * 400) for c in range(3) for r in range(3)]
    schema = "conv_id long, round long, text string"
    data = spark.createDataFrame(rows, schema)
    batch = {r["conv_id"]: (r["text"], r["truncated"]) for r in refold.refold(data, 160, 220, 11).collect()}
    for r in range(3):  # a trigger a round
        data.where(F.col("round") == r).write.mode("append").parquet(str(tmp_path / "in"))
        refold.follow(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path), 160, 220, 11)
    assert {r["conv_id"]: (r["text"], r["truncated"]) for r in refold.latest_states(spark, str(tmp_path)).collect()} == batch
    assert {r["rounds"] for r in refold.latest_states(spark, str(tmp_path)).collect()} == {3}


def test_normalize_any_script(spark):
    from foliant.functions import unicode

    cases = {"tests ✅ done 🎉": "tests [OK] done", "café ①": "café 1", "日本": "??", "ﬁńe": "fine", "┌─│": "+-|", "a​b": "ab"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", unicode.normalize_udf()("t").alias("n")).collect()
    assert {r["t"]: r["n"]["text"] for r in rows} == cases
    assert unicode.normalize("日", frozenset("日"), {}) == ("日", 1, 0)


def test_white_space_of_all_kinds(spark):
    from foliant.functions import unicode

    given_text = "a  b c　​d\u0085e﻿f"
    assert unicode.normalize(given_text, frozenset(), {})[0] == "a b█c def"
    assert value(spark, T.collapse_space(F.lit(given_text))) == "a b█c d\u0085ef"
