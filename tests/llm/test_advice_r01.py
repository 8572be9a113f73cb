
import corpus_pipeline
from foliant.llm import decontamination, line_dedup, near_dedup, quality_rules
from tests.llm import fixtures as fx


def test_line_dedup_finds_one_word_more(spark):
    rows = [(1, "alpha beta gamma delta\nfar from all others"), (2, "alpha beta gamma delta epsilon\nalpha beta gamma zeta"), (3, "a b c d e f g h i\na b c d e f g h j")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    # 4 of 5 words and 8 of 10 are shared: 0.8; 3 of 5: 0.6
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {1: rows[0][1], 2: "alpha beta gamma zeta", 3: "a b c d e f g h i"}


def test_near_stage_links_from_four_fifths(spark):
    base = [f"t{i}" for i in range(204)]  # 200 shingles
    rows = [(1, " ".join(base)), (2, " ".join([*base[:184], *(f"z{i}" for i in range(20))])), (3, " ".join([*base[:150], *(f"y{i}" for i in range(54))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    comps, _ = fx.components(rows, 80)
    assert comps == {1: 1, 2: 1, 3: 3} and fx.components(rows)[0] == {1: 1, 2: 2, 3: 3}
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_near(spark, docs, "").collect()) == [1, 3]
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == fx.components(rows)[0]
    assert near_dedup.matches_for(85) == 34 and near_dedup.matches_for(80) == 30  # all but one link in a billion


def test_decontamination_searches_items_without_id(spark):
    docs = spark.createDataFrame([(1, f"before {fx.PASSAGE} after"), (2, "nothing of it"), (3, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(None, fx.PASSAGE), (7, "one two"), (None, "one two")], "item_id long, text string")
    for options in ({}, {"block_bytes": 20}):
        seen, out = decontamination.scan(docs, items, **options)
        rows = {r["doc_id"]: r[out] for r in seen.collect()}
        assert (rows[1]["n_hit"], list(rows[1]["items"]), rows[1]["contaminated"]) == (30, [None], True)
        assert rows[2]["n_hit"] == 0 and not rows[2]["contaminated"]
        assert (rows[3]["n_hit"], list(rows[3]["items"])) == (2, ["7", None])
    assert [r["doc_id"] for r in decontamination.remove_contaminated(docs, items).collect()] == [2]


def test_quality_rules_judge_small_groups_by_themselves(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j * 13) % 900}" for j in range(120)), "en", "s") for i in range(300)]
    dense = [(1000 + i, " ".join(f"{(i * 7 + j * 13) % 900:03d}" * 20 for j in range(120)), "zz", "t") for i in range(60)]
    judged, out = quality_rules.judge(spark.createDataFrame(clean + dense, "doc_id long, text string, lang string, source string"))
    assert judged.where(f"{out}.kept").count() == 360
