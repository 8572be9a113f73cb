"""Frame files: whole and right for any text and key, opened by the rows that name them."""

import base64
import hashlib

import duckdb
import pytest

from foliant.plans import catalog
from foliant.sources import frame_store, frames
from tests.test_catalog import SF, comparable


@pytest.mark.parametrize(
    "odd",
    [{2: None, 3: "", 4: None, 5: "", 6: ""}, {20: "x", 15: "gonex", 16: "", 11: "gone"}, {-1: "a", -2: None, -3: "b", -4: "c", -5: "d", -8: "d", None: "e"}],
    ids=["texts of no bytes", "texts that begin like a file that is gone", "keys below 0"],
)
def test_frame_files_of_odd_rows(spark, tmp_path, odd):
    rows = [(i, text, "en", "web", 0) for i, text in ({i: f"text {i}" for i in range(24)} | odd).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["frame_files"](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = connection.sql(catalog.ORACLE_SQL["frame_files"])
    assert comparable([tuple(r) for r in found.collect()], found.columns) == comparable(expected.fetchall(), expected.columns)


def test_empty_frames_are_files_if_asked_for(spark, tmp_path):
    pngs = spark.createDataFrame([("archive-frames-1", b""), ("archive-frames-2", None), ("../up", b"")], "frames_dir string, png binary")
    frame_store.save(pngs, str(tmp_path))
    assert not list(tmp_path.iterdir())
    frame_store.save(pngs, str(tmp_path), empty=True)
    assert [(str(p.relative_to(tmp_path)), p.read_bytes()) for p in tmp_path.rglob("*") if p.is_file()] == [(f"archive-frames-1/{hashlib.sha256(b'').hexdigest()}.png", b"")]


def test_driver_lists_no_frame_files(spark):
    assert {f.rpartition("/")[2] for f in catalog.QUERIES["frame_files"](spark, SF).inputFiles()} == {"documents.parquet"}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_files_are_opened_by_their_rows(spark, tmp_path, scheme):
    """Contents of more than a block leave in several parts, each beside its row."""
    folder = tmp_path / "archive-frames-1"
    folder.mkdir()

    def stored(png, name=None):
        name = name or hashlib.sha256(png).hexdigest() + ".png"
        (folder / name).write_bytes(png)
        return name

    pngs = [bytes([i]) * 1_000_000 for i in range(7)] + [b"small", b""]
    good = {stored(png): base64.b64encode(png).decode() for png in pngs}
    forged, gone = stored(b"other", "0" * 64 + ".png"), "f" * 64 + ".png"
    name = next(iter(good))
    cases = [("archive-frames-1", file, None, data) for file, data in good.items()]
    cases += [("archive-frames-1", name, "own", "own"), ("archive-frames-1", name, "", good[name]), ("archive-frames-1", forged, None, None), ("archive-frames-1", gone, None, None), ("archive-frames-2", name, None, None)]
    cases += [("archive-frames-1", "../archive-frames-1/" + name, None, None), ("../archive-frames-1", name, None, None), (None, name, None, None), ("archive-frames-1", None, None, None), (None, None, "own", "own")]
    asked = spark.createDataFrame([(i, *case[:2], i, case[2]) for i, case in enumerate(cases)], "conv_id long, frames_dir string, file string, pos long, data string").coalesce(1)
    found = frames.resolved(asked, scheme + str(tmp_path))
    assert found.columns == asked.columns
    assert [tuple(r) for r in found.collect()] == [(i, *case[:2], i, case[3]) for i, case in enumerate(cases)]
    assert frames.resolved(asked.limit(0), str(tmp_path)).collect() == []
