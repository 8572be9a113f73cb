"""64-bit hashes of all words of several texts at once.

A word is a maximal run of bytes other than ASCII white space. Arrow splits the texts and numbers the distinct words;
each distinct word is hashed once, by XXH3 with 128 bits. That is no polynomial of the bytes: words get different hashes
however long and however alike they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def hash_words(texts: list[bytes | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes (rows) and the byte lengths of all words in order, and where each text's words start (one more than texts)."""
    raw = [(t.translate(LOWER) if fold else t) if t else b"" for t in texts]
    split = pc.ascii_split_whitespace(pa.array(raw, pa.large_binary()).view(pa.large_string()))
    words = split.flatten().view(pa.large_binary())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    real = lengths > 0  # white space at an end of a text leaves an empty word
    before = np.concatenate([[0], np.cumsum(real)])
    starts = before[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)]
    numbered = words.filter(pa.array(real)).dictionary_encode()
    distinct = numbered.dictionary
    ends = np.cumsum(pc.binary_length(distinct).to_numpy(zero_copy_only=False)).tolist()
    data = distinct.buffers()[2].to_pybytes() if ends else b""
    digests = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip([0, *ends], ends)])
    table = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return table[numbered.indices.to_numpy()].T.astype(U), lengths[real], starts
