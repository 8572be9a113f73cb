"""Small documents with every awkward case, and brute-force versions of the operators."""

import re
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"
PASSAGE = " ".join(f"w{i}" for i in range(30))
LONG = " ".join(f"v{i % 977}" for i in range(4000))

#: doc_id, text, lang, source, n_chars and columns whose names clash with the operators' own.
DOCS = [
    (1, f"First line here\n{PASSAGE} end", "en", "a"),
    (2, f"start {PASSAGE} other\nFirst line here", "en", "a"),
    (3, f"First line here\n{PASSAGE} end", "de", None),
    (3, f"First line here\n{PASSAGE} end", "de", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \n\t ", "fr", None),
    (7, "one two", "fr", "b"),
    (8, LONG, "en", "a"),
    (9, "x " * 60, "en", "a"),
    (10, f"First line here\n{PASSAGE} END", "en", "a"),
    (None, "call (212) 555-0100 or mail a.b@c.de, ip 10.0.0.1, card 4111 1111 1111 1111, +1 (212) 555-0100", "en", "a"),
    (11, "größe straße käse über müde schön — „äöü“ ñandú", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, line string, d int, h int, set string, rank int, passages int"


def documents(spark, rows=DOCS):
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", "l", 1, 2, "t", 3, 4) for r in rows], SCHEMA)


def words(text):
    return re.findall(WORD, text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def passages(rows, window=20):
    """{doc_id: kept words}; equal ids do not repeat each other."""
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i)) if d is not None else (-1, i)
    out = {}
    for d, t, *_ in rows:
        w, gone, seen = words(t), set(), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen or (d is not None and first[key][0] < d):
                gone.update(range(i, i + window))
            seen.add(key)
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def components(rows, threshold=85):
    sets = {}
    for d, t, *_ in rows:
        w = words(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [d for d in sets if sets[d]]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda v: (v is not None, v or 0))
                parent[y] = x
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def repeated(w):
    c = Counter(zip(w, w[1:], w[2:]))
    return len({j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
