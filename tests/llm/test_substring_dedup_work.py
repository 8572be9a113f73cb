"""op2 does no more work than it must."""

from foliant.llm import substring_dedup
from tests.llm import fixtures as fx


def test_substring_dedup_parses_a_text_once_a_step(spark, tmp_path, monkeypatch):
    rows = [(i, f"a{i} b{i} " + fx.PASSAGE + f" c{i % 3} " + " ".join(f"w{j}" for j in range(i % 4 * 20))) for i in range(40)]
    for name in ("segment_rows", "window_rows"):

        def counted(batches, f=getattr(substring_dedup, name), log=str(tmp_path / name)):
            for batch in batches:
                with open(log, "a") as file:
                    file.write("".join(f"{d}\n" for d in batch["d"].to_pylist()))
                yield from f([batch])

        monkeypatch.setattr(substring_dedup, name, counted)
    found, out = substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r[out]["kept"] for r in found.collect()} == {d: " ".join(w) for d, w in fx.passages(rows).items()}
    for name in ("segment_rows", "window_rows"):
        parsed = (tmp_path / name).read_text().split()
        assert parsed and len(parsed) == len(set(parsed)), name
