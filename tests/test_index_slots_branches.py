"""The stream's index, late frames, branches, arguments, fonts and pages of any width: what their queries do not show."""

import hashlib
import random

from pyspark.sql import functions as F

from foliant.functions import cells
from foliant.functions.unicode import normalize, normalize_routed
from foliant.operators import archive, branches, layout, transcript, writing
from foliant.sources import fonts, frames
from foliant.streaming.index import ArchiveIndex

KEY = bytes(range(32))
ENTRY = f"conv_id long, ts long, seq long, lead_in string, frames_dir string, frames array<{writing.FRAME}>, total_chars long, truncated_chars long, text string, text_head string, text_tail string, mac string"


def entry(conv, ts, seq, folder, text="x", total=1):
    return (conv, ts, seq, "lead", folder, [], total, 0, text, "", "", "")


def signed(spark, rows):
    valid = archive.validate(spark.createDataFrame(rows, ENTRY))
    return valid.withColumn("mac", archive.hmac_sha256(archive.canonical(valid.drop("ts", "seq")), KEY))


def test_index_replays_and_collects_garbage(spark, tmp_path):
    root, stored = str(tmp_path / "index"), tmp_path / "frames"
    names = [f"archive-frames-{i}" for i in range(1, 6)] + ["archive-frames-9", "own"]
    for name in names:
        (stored / name).mkdir(parents=True)
    index = ArchiveIndex(spark, root, KEY)
    first = signed(spark, [entry(1, 10, 1, names[0]), entry(2, 10, 2, names[1]), entry(None, 10, 3, names[2]), entry(3, None, 4, names[2]), entry(4, 1, 1, None, text="")])
    then = signed(spark, [entry(1, 20, 5, names[3]), entry(1, 10, 6, names[4])]).unionByName(signed(spark, [entry(2, 30, 7, names[5])]).withColumn("total_chars", F.lit(99).cast("long")))
    for batch, rows in ((0, first), (1, then), (1, then), (0, first)):  # both again, as after a restart
        index.upsert(rows, batch)
    seen = lambda: {(r["conv_id"], r["ts"]): r["seq"] for r in index.entries().collect()}
    assert seen() == {(1, 10): 6, (1, 20): 5, (2, 10): 2}
    assert {r["conv_id"]: r["rejected"] for r in index.rejected().collect()} == {1: 0, 2: 1}
    assert index.collect_garbage(str(stored)) == 2  # the older ones of conversation 1
    assert sorted(p.name for p in stored.iterdir()) == ["archive-frames-2", "archive-frames-3", "archive-frames-4", "archive-frames-9", "own"]
    index.merge_batches(1)
    assert seen() == {(1, 10): 6, (1, 20): 5, (2, 10): 2} and {r["batch"] for r in index.written().select("batch").collect()} == {1}
    assert {r["conv_id"]: r["rejected"] for r in index.rejected().collect()} == {1: 0, 2: 1}
    assert ArchiveIndex(spark, str(tmp_path / "none"), None).upsert(first, 0) is None
    assert ArchiveIndex(spark, str(tmp_path / "none"), None).entries().count() == 0
    unchecked = ArchiveIndex(spark, str(tmp_path / "all"), None, verify=False)
    unchecked.upsert(then, 0)
    assert unchecked.entries().count() == 3


def test_slots_read_only_what_is_admitted(spark, tmp_path):
    root = tmp_path / "frames"
    folder = root / "archive-frames-1"
    folder.mkdir(parents=True)

    def stored(body, name=None):
        name = name or hashlib.sha256(body).hexdigest() + ".png"
        (folder / name).write_bytes(body)
        return name

    good, large = stored(b"g" * 30), stored(b"l" * 300)
    forged = stored(b"other", "0" * 64 + ".png")
    gone = "f" * 64 + ".png"
    kept, omitted, missing = archive.KEPT, archive.OMITTED, archive.UNAVAILABLE
    cases = {
        1: ("archive-frames-1", [(None, good), (None, gone), (None, forged), ("inline", None)], [kept, missing, missing, kept]),
        2: ("archive-frames-1", [("x" * 10, None), (None, good), (None, large)], [kept, omitted, kept]),  # 400 bytes used, the estimate is 200 of 500
        3: ("../archive-frames-1", [(None, good)], [missing]),
        4: ("archive-frames-1", [(None, "../" + good), ("", None)], [missing, missing]),
        5: (None, [("x" * 600, None), ("x" * 500, None)], [omitted, kept]),
        6: ("archive-frames-1", [], []),
        7: ("archive-frames-1", None, None),
    }
    rows = [(k, d, None if f is None else [(data, file) for data, file in f]) for k, (d, f, _) in cases.items()]
    data = spark.createDataFrame(rows, "conv_id long, frames_dir string, frames array<struct<data:string,file:string>>")
    for where in (str(root), root.as_uri()):
        found = {r["conv_id"]: r["slots"] for r in frames.with_slots(data, where, 500, 200).collect()}
        assert {k: None if s is None else [x["state"] for x in s] for k, s in found.items()} == {k: v[2] for k, v in cases.items()}
    assert [x["bytes"] for x in found[2]] == [10, 200, 400]


def test_notes_of_gaps_in_order(spark, tmp_path):
    states = "UOUOKUKOOUKUUO"
    slots = [(({"U": "unavailable", "O": "omitted", "K": "kept"})[c], 100 * (c == "O"), f"d{i}" if c == "K" else None) for i, c in enumerate(states)]
    made = spark.createDataFrame([(1, slots, None, "tail", 0)], f"conv_id long, slots array<{archive.SLOT}>, text_head string, text_tail string, truncated_chars int")
    rows = archive.blocks(made, 1).orderBy("pos").collect()
    short = ["K" if r["type"] == "image" else "U" if "missing here" in r["text"] else r["text"].split("\n")[1].split(" ")[0] if "left out here" in r["text"] else "-" for r in rows]
    # an omitted page is counted in one note before the next image or the end
    assert short[1:] == ["U", "2", "K", "U", "K", "2", "U", "K", "U", "U", "1"] or short == ["U", "U", "2", "K", "U", "K", "2", "U", "K", "U", "U", "1"]
    assert rows[0]["text"].startswith(archive.OPEN) and rows[-1]["text"].endswith("tail\n" + archive.CLOSE) and [r["pos"] for r in rows] == list(range(len(rows)))


def test_written_frames_are_whole(spark, tmp_path):
    root = tmp_path / "out"
    rows = spark.createDataFrame([("archive-frames-1", bytearray(b"a")), ("archive-frames-1", bytearray(b"a")), ("archive-frames-2", bytearray(b"b")), ("../x", bytearray(b"c")), ("archive-frames-3", None)], "frames_dir string, png binary")
    for where in (str(root), root.as_uri()):  # twice: a task that runs again
        assert frames.write(rows, where).count() == 2
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()) == sorted(f"archive-frames-{i}/{hashlib.sha256(b).hexdigest()}.png" for i, b in ((1, b"a"), (2, b"b")))
    (root / "archive-frames-1" / ".half").write_bytes(b"z")
    assert frames.read(spark, str(root)).count() == 2
    assert frames.remove_superseded(str(root), spark.createDataFrame([("archive-frames-2",)], "frames_dir string")) == ["archive-frames-1"]


def test_first_above(spark):
    chain = [(1, i, i - 1 if i else None, i in (3, 900)) for i in range(1000)]
    odd = [(2, 1, 2, False), (2, 2, 1, False), (2, 3, 1, False), (2, 4, 77, False), (2, 5, 5, True), (2, 6, 6, False), (3, 1, None, False)]
    rows = spark.createDataFrame(chain + odd, "conv_id long, id long, parent_id long, stop boolean")
    found = {(r["conv_id"], r["id"]): r["found"] for r in branches.first_above(rows, F.col("stop")).collect()}
    assert all(found[1, i] == (900 if i >= 900 else 3 if i >= 3 else None) for i in range(1000))
    assert {k[1]: v for k, v in found.items() if k[0] == 2} == {1: None, 2: None, 3: None, 4: None, 5: 5, 6: None} and found[3, 1] is None
    assert branches.first_above(rows.limit(0), F.col("stop")).count() == 0


def test_arguments(spark):
    cases = {
        '{"b": [1, {"z": 1, "a": null}], "a": "x\\n\\"y]["}': [("b", '[1,{"z":1,"a":null}]'), ("a", '"x\\n\\"y]["')],
        "{}": [],
        "[1]": [],
        "no json": [],
        None: [],
        '{"t": true, "n": 1.5, "s": "1.5", "e": ""}': [("t", "true"), ("n", "1.5"), ("s", '"1.5"'), ("e", '""')],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", transcript.arguments(F.col("t")).alias("a")).collect()
    assert {r["t"]: [tuple(x) for x in r["a"]] for r in rows} == cases


def test_plans_of_any_width(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab 界語\u000e\u000f") for _ in range(rng.randrange(900))) for _ in range(60)] + ["", "a" * 500, "\u000e" * 300, "a" * 100 + "\u000e" * 100 + "a" * 100, "界" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string").withColumn("note", F.lit("n"))
    for most in (1, 5, 100):
        plans = layout.plan(rows, 35, 54, most, (7, 9))
        assert plans.columns[:2] == ["conv_id", "note"]
        for r in plans.collect():
            text = texts[r["conv_id"]]
            middle = text[35 : len(text) - 35] if len(text) > 70 else ""
            fine = cells.cut_pages(middle, 35, 7, True)
            if len(fine) <= most:
                expected = [("high", p) for p in fine]
            else:
                edge = min(layout.EDGE_PAGES, (most - 1) // 2)
                first, last = fine[:edge], fine[len(fine) - edge :]
                inner = middle[len("".join(first)) : len(middle) - len("".join(last))]
                dense = cells.cut_pages(inner, 54, 9, True)
                expected = [("high", p) for p in first] + [("low", p) for p in dense[-(most - 2 * edge) :]] + [("high", p) for p in last]
            assert [tuple(p) for p in r["pages"]] == expected, (most, text)


def test_routed_normalization(spark):
    texts = ["plain café", "日本 x", "a✅b — “q” │", "é ő", "🎉", "", "a b​c", "ﬁ日"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_routed(F.col("t"), frozenset("日")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {t: normalize(t, frozenset("日"), {})[0] for t in texts}


def test_coverage_by_bitmaps(spark):
    points = [("a", cp) for cp in (0, 65, 32766, 32767, 32768, 65535, 0x1F600)] + [("b", 66), ("b", 65), ("c", 67)]
    covered = fonts.with_fallback(fonts.coverage(spark.createDataFrame(points, "font string, cp int")), "a", "b")
    asked = [0, 1, 65, 66, 67, 32766, 32767, 32768, 32769, 65535, 0x1F600, 0x1F601]
    chars = spark.createDataFrame([(chr(c),) for c in asked], "ch string")
    found = {ord(r["ch"]): r["printable"] for r in fonts.printable(chars, covered).collect()}
    assert found == {c: c in {0, 65, 66, 32766, 32767, 32768, 65535, 0x1F600} for c in asked}
    texts = spark.createDataFrame([(1, "AA BZZ"), (2, None), (3, " ")], "id long, text string")
    assert {r["id"]: (r["visible"], r["lost"]) for r in fonts.text_stats(texts, covered).collect()} == {1: (5, 2), 2: (0, 0), 3: (0, 0)}
