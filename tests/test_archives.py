"""Writing and reading archives: what SQL does not show."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import keys
from foliant.functions.text import CELL, DIM_OFF, DIM_ON
from foliant.operators import archive, blocks, context, raster, writing
from foliant.sources import frames

KEY = bytes(range(32))
REQUEST = "conv_id long, first_kept string, text string, summary string, previous struct<text:string,text_head:string,text_tail:string,truncated_chars:bigint>, files string"


def compacted(spark, *rows, **options):
    made = writing.compact(spark.createDataFrame(list(rows), REQUEST), high=(10, 2), low=(10, 4), most=5, shape="s", **options)
    return {r["conv_id"]: r for r in made.collect()}


def test_compact(spark):
    long = " ".join(f"word{i}" for i in range(200))
    old = ("data:image/png;base64,AAAA" + CELL + "old", None, None, 7)
    rows = compacted(spark, (1, "e", "", None, None, None), (2, "e", "short", "was", None, "a (read)"), (3, "e", "new", "unused", old, None), (4, "e", f"{DIM_ON}{long}{DIM_OFF}", None, None, None))
    assert rows[1]["lead_in"] == rows[1]["summary"] == writing.NOTHING and rows[1]["frames"] == [] and rows[1]["frames_dir"] is None
    assert rows[2]["text"] == "[Digest of earlier history] was [Recent conversation] short" and "Files:\na (read)" in rows[2]["lead_in"] and "digest" in rows[2]["lead_in"]
    assert rows[3]["text"].endswith(f"{CELL}old{CELL}new") and "AAAA" not in rows[3]["text"] and rows[3]["truncated_chars"] == 7
    pages = rows[4]["pages"]
    assert len(pages) == len(rows[4]["frames"]) == 5 and all(p["text"].startswith(DIM_ON) for p in pages) and rows[4]["text_tail"].startswith(DIM_ON)
    assert rows[4]["truncated_chars"] > 0 and "Characters dropped" in rows[4]["lead_in"] and rows[4]["frames_dir"] == "archive-frames-4"
    kept = len(rows[4]["text"].replace(DIM_ON, "").replace(DIM_OFF, ""))
    assert rows[4]["total_chars"] == kept + 3  # the edges count with their ink marks
    with pytest.raises(Exception, match="first_kept is missing"):
        compacted(spark, (1, None, "x", None, None, None))


def test_thoughts_leave_the_old_text(spark):
    old = (f"»user:a\n\n»think:secret\n\n»ai:b{CELL}more", None, None, 0)
    row = compacted(spark, (1, "e", "new", None, old, None), thinking=False)[1]
    assert "secret" not in row["text"] and row["text"].startswith("»user:a") and "»think:" not in row["lead_in"]


def test_typed_blocks(spark):
    block = lambda kind, text=None, call=None: (kind, text, call, "run" if call else None, [("k", '"v"')] if call else None)
    rows = [
        (1, 1, "user", [block("text", "a"), block("image", "zzz"), block("text", "b")], None),
        (1, 2, "assistant", [block("thinking", "t1"), block("text", " "), block("thinking", "t2"), block("toolCall", None, "c1"), block("text", "x"), block("text", "y")], None),
        (1, 3, "toolResult", [block("text", "first")], "c1"),
        (1, 4, "toolResult", [block("text", "last")], "c1"),
        (1, 5, "toolResult", [block("text", "loose")], "c9"),
        (2, 1, "user", None, None),
        (2, 2, "assistant", [], None),
    ]
    messages = spark.createDataFrame(rows, f"conv_id long, turn long, role string, blocks {blocks.BLOCKS}, call_id string")
    out = lambda t: f"<out>\n{DIM_ON}{t}{DIM_OFF}\n</out>"
    expected = f"»user:ab\n\n»think:t1\nt2\n\n»tool:run(k=\"v\")\n{out('last')}\n\n»ai:x\ny\n\n»tool:\n{out('loose')}"
    assert {r["conv_id"]: r["text"] for r in blocks.transcripts(messages).collect()} == {1: expected}
    assert "t1" not in blocks.transcripts(messages, thinking=False).first()["text"]


FRAMES = "array<struct<data:string,file:string,mime_type:string,cols:int,rows:int,chars:bigint>>"
ARCHIVE = f"conv_id long, lead_in string, frames_dir string, frames {FRAMES}, total_chars long, truncated_chars long, text string, text_head string, text_tail string, mac string"


def archives(spark, *texts):
    rows = [(i, "lead", "archive-frames-1", [("AAAA", None, "image/png", 1, 2, 3), ("", "bad", "image/png", 1, 2, 3)], 5, 0, t, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ARCHIVE)


def test_signatures_cover_the_valid_form(spark):
    signed = writing.signed(archives(spark, "a", "b"), KEY)
    assert [len(r["frames"]) for r in signed.collect()] == [1, 1]  # the invalid frame is gone before signing
    assert context.trusted(signed, KEY).count() == 2 and context.trusted(signed, bytes(32)).count() == 0
    assert context.trusted(signed, None).count() == 0 and context.trusted(signed, None, verify=False).count() == 2
    changed = signed.withColumn("frames", F.transform("frames", lambda f: f.withField("chars", f["chars"] + 1)))
    assert context.trusted(changed, KEY).count() == 0
    entries = signed.withColumn("conv_id", F.lit(9).cast("long")).withColumn("ts", F.monotonically_increasing_id()).withColumn("seq", F.lit(0))
    assert context.latest_trusted(entries, KEY).count() == 0  # the id is part of what is signed: the newest entry is not trusted, and hides the other


def test_frame_files(spark, tmp_path):
    root = str(tmp_path)
    pngs = spark.createDataFrame([("archive-frames-1", b"one"), ("archive-frames-1", b"one"), ("archive-frames-2", b"two"), ("../up", b"no"), ("archive-frames-2", None)], "frames_dir string, png binary")
    assert sorted((r["frames_dir"], r["bytes"]) for r in frames.write(pngs, root).collect()) == [("archive-frames-1", 3), ("archive-frames-2", 3)]
    (tmp_path / "archive-frames-2" / ("0" * 64 + ".png")).write_bytes(b"not its name")
    (tmp_path / "archive-frames-x").mkdir()
    stored = frames.read(spark, root)
    assert sorted(bytes(r["content"]) for r in stored.collect()) == [b"one", b"two"]
    moved = frames.externalized(archives(spark, "a")).first()["frames"]
    assert moved[0]["data"] == "" and archive.FILE_NAME and len(moved[0]["file"]) == 68 and moved[1]["file"] == "bad"
    persisted = spark.createDataFrame([("archive-frames-2",), (None,)], "frames_dir string")
    assert frames.remove_superseded(root, persisted) == ["archive-frames-1"]
    assert sorted(os.listdir(root)) == ["archive-frames-2", "archive-frames-x"]


def test_keys(tmp_path):
    key = keys.load_or_create(tmp_path / "a")
    assert len(key) == 32 and keys.load_or_create(tmp_path / "a") == key
    assert (tmp_path / "a" / keys.KEY_FILE).stat().st_mode & 0o777 == 0o600
    (tmp_path / keys.KEY_FILE).write_text("broken")
    assert keys.load_or_create(tmp_path) is None and (tmp_path / keys.KEY_FILE).read_text() == "broken"
    assert keys.verification_off({"FOLIANT_VERIFY": " OFF"}) and not keys.verification_off({}) and not keys.verification_off({"FOLIANT_VERIFY": "yes"})


def test_resampling_and_blending():
    bits = np.array([[1, 0], [0, 1]], float)
    got = raster.resampled(bits, 4, 4)
    for y in range(4):
        for x in range(4):
            fy, fx = (y + 0.5) / 2 - 0.5, (x + 0.5) / 2 - 0.5
            v = sum(bits[i, j] * max(0, 1 - abs(fy - i)) * max(0, 1 - abs(fx - j)) for i in range(2) for j in range(2))
            assert abs(got[y, x] - (round(v * 255) / 255 if v > 0.02 else 0)) < 1 / 254
    canvas = np.full((2, 2, 3), 255, np.uint8)
    raster.blend(canvas, np.full((2, 2), 0.5), 1, -1, (0, 0, 0))  # three of four pixels lie outside
    assert canvas[0, 1].tolist() == [128, 128, 128] and (canvas != 255).sum() == 3


def test_two_columns():
    sheet = raster.Sheet(4, 8, 104, columns=2)  # 26 cells: two columns of 12 and a gutter
    cells = raster.placed("\n".join(["abcdefghijklmn"] * (sheet.rows + 1)), sheet)
    assert sheet.cols == 12 and sheet.rows == 12
    assert [(c, col, row) for c, col, row, _ in cells[:2]] == [("a", 0, 0), ("b", 1, 0)] and len(cells) == 12 * 13
    assert cells[12 * 12][1:3] == (14, 0)  # the thirteenth line opens the right column
    canvas, n = raster.Painter(sheet, raster.test_glyphs()).page("a\nb")
    assert n == 2 and canvas.shape == (24, 104, 3)
    wide = raster.placed("a日", raster.Sheet(4, 8, 8))
    assert [(c, col, row) for c, col, row, _ in wide] == [("a", 0, 0)] or wide[1][1] == 0
