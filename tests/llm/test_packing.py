"""Packing against a plain best-fit packer, and the tokenizer's own tokens."""

from collections import Counter

import numpy as np
import pytest

from foliant.llm import packing


def best_fit_decreasing(lengths, capacity):
    """Number of sequences when the longest goes first into the sequence with the smallest rest that takes it."""
    rests, used = Counter(), 0
    for n in sorted(lengths, reverse=True):
        rest = min((r for r in rests if r >= n), default=None)
        if rest is None:
            used, rest = used + 1, capacity
        else:
            rests[rest] -= 1
            if not rests[rest]:
                del rests[rest]
        rests[rest - n] += 1
    return used


@pytest.mark.parametrize("name", ["uniform", "narrow", "lognormal", "few"])
def test_never_more_sequences_than_best_fit(name):
    rng = np.random.default_rng(10)
    made = {"uniform": lambda: rng.integers(1, 2048, 6000), "narrow": lambda: rng.integers(650, 760, 6000), "lognormal": lambda: np.clip(rng.lognormal(6, 1, 6000), 1, 2047).astype(int), "few": lambda: rng.choice([700, 650, 690, 1024, 3], 3000)}
    lengths = made[name]().tolist()
    runs = packing.best_plan(dict(Counter(lengths)))
    filled, placed = Counter(), Counter()
    for length, _, n, first, offset in runs:
        placed[length] += n
        for s in range(first, first + n):
            assert offset == filled[s]  # gapless
            filled[s] += length
    assert placed == Counter(lengths) and max(filled.values()) <= packing.CAPACITY
    assert len(filled) == packing.sequences(runs) <= best_fit_decreasing(lengths, packing.CAPACITY)


def test_own_tokens_of_the_vocabulary():
    encoder = packing.Encoder(packing.default_tokenizer())
    import pyarrow as pa

    texts = ["a <|endoftext|> b", "a<|endoftext|>b c", "plain words here", "<|endoftext|>", "x <|endof text|> y"]
    found = encoder.encode(pa.array(texts))
    for text, ids in zip(texts, found):
        assert list(np.frombuffer(ids, "<u4")) == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]
    assert encoder.tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_batches_are_bounded_by_bytes_not_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "BATCH_BYTES", 60_000)
    short = pa.array(["plain words here"] * 3000 + [None, ""])  # 48 kB: one batch, so each word is looked up once
    assert [len(b) for b in packing.batches(short)] == [3002]
    long = pa.array(["x" * 50_000] * 7)
    assert max(len(b) for b in packing.batches(long)) <= 2
    assert pa.concat_arrays(list(packing.batches(long))).equals(long) and sum(map(len, packing.batches(pa.array([], pa.string())))) == 0
