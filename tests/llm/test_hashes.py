"""Words and rows that weak hashes take for equal."""

from pyspark.sql import functions as F

from foliant.llm import near_dedup, substring_dedup
from foliant.llm.word_hash import hash_words
from tests.llm import fixtures as fx

#: Thue-Morse words: polynomials modulo a power of two take them for equal, whatever the base.
THUE = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(4096)) for flip in (0, 1)]


def test_hashes_of_words_made_to_collide():
    hashes, lengths, starts = hash_words([f"{THUE[0]} x\t{THUE[1]}".encode(), None, b" \n", THUE[0].upper().encode()], fold=True)
    assert lengths.tolist() == [4096, 1, 4096, 4096] and starts.tolist() == [0, 3, 3, 3, 4]
    assert (hashes[:, 0] == hashes[:, 3]).all() and (hashes[:, 0] != hashes[:, 2]).all()


def test_passages_of_different_long_words(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(19)) + f" {word} tail{i}") for i, word in enumerate(THUE)]
    rows += [(2 + i, " ".join("pq"[(bin(k).count("1") + i) % 2] for k in range(3000))) for i in (0, 1)]
    found, out = substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = fx.passages(rows)
    assert {r["doc_id"]: r[out]["kept"] for r in found.collect()} == {d: " ".join(w) for d, w in expected.items()}
    assert len(expected[1]) == 21


def test_near_duplicates_of_different_long_words(spark):
    rows = [(1, THUE[0]), (2, THUE[1]), (3, THUE[0])] + [(4 + i, " ".join("pq"[(bin(k).count("1") + i) % 2] for k in range(3000))) for i in (0, 1)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    component, _ = fx.components(rows)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == component


def test_texts_of_one_id_with_equal_short_hashes(spark):
    """Two texts of id 5 with one 32-bit hash, one of them a copy of document 1's passage."""
    many = spark.range(200_000).select(F.concat(F.lit("q0 q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15 q16 q17 q18 q19 t"), "id").alias("own"), F.concat(F.lit(fx.PASSAGE), F.lit(" t"), "id").alias("copy"))
    own, copy = (many.select(c, F.hash(c).alias("h")) for c in ("own", "copy"))
    pair = own.join(copy, "h").first()
    rows = [(1, fx.PASSAGE), (5, pair["own"]), (5, pair["copy"])]
    found, out = substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["text"], r[out]["n_removed"]) for r in found.collect()} == {(fx.PASSAGE, 0), (pair["own"], 0), (pair["copy"], 30)}
