"""Normalization of any script, with counts of what would print as ``?``.

Texts up to U+00FF take the native path of ``functions.text``; this Arrow function is for the others.
Each distinct character is resolved once a batch and remembered; of a text only the runs of white space that change and
the few characters that do not print as they are cost a step in Python.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.batches import in_blocks
from foliant.functions.text import CELL, MARKS, PUNCTUATION, STATUS_SIGNS, normalize_latin

PICTOGRAPH = regex.compile(r"\p{Extended_Pictographic}")
INVISIBLE = regex.compile(r"[\p{Cc}\p{Mn}\p{Me}\p{Cs}]")
MARK_RUN = regex.compile(r"\p{M}+")
WHITE = r"\t\n\x0b\x0c\r \xa0  -     　﻿"
FORMAT = "".join(regex.findall(r"\p{Cf}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))))
#: Those beyond the basic plane, for which a class of characters is much slower.
FAR = frozenset(ch for ch in FORMAT if ch > "\uffff")


def runs(without: frozenset[str]) -> re.Pattern[str]:
    """Runs of white space and invisible characters, but for a space that stands alone."""
    run = f"[{WHITE}{''.join(ch for ch in FORMAT if ch not in without)}]"
    return re.compile(f"{run}(?:{run}+|(?<! ))")


NEAR_RUNS, ALL_RUNS = runs(FAR), runs(frozenset())
BREAK, SOLID = regex.compile(r"[\n\r  ]"), regex.compile(r"[^\p{Cf}]")
EDGES = f" {CELL}"
SPACES = re.compile("  +")
ANSI = regex.compile("\x1b\\[[0-9;?]*[ -/]*[@-~]|\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\\\\\)")


def is_latin(ch: str) -> bool:
    return " " <= ch <= "~" or "\xa0" <= ch <= "\xff"


def skeleton(ch: str) -> str | None:
    """The Latin-1 form of a compatibility decomposition without its marks; None where there is none."""
    parts = MARK_RUN.sub("", unicodedata.normalize("NFKD", ch))
    if parts == ch:
        return None
    shown = [p if is_latin(p) else PUNCTUATION.get(p) for p in parts]
    return None if None in shown else "".join(shown)


def resolve(ch: str, printable: frozenset[str]) -> tuple[str, int, int]:
    """What prints for a character, whether it counts as visible, and whether it is lost."""
    if is_latin(ch):
        return ch, 1, 0
    if ch in MARKS or ch == CELL:
        return ch, 0, 0
    for table in (STATUS_SIGNS, PUNCTUATION):
        if ch in table:
            return table[ch], 1, 0
    if "─" <= ch <= "╿":
        return "|" if ch in "│┃" else "-" if ch in "─━" else "+", 1, 0
    picture = bool(PICTOGRAPH.match(ch))
    if ch in printable and not picture:
        return ch, 1, 0
    folded = skeleton(ch)
    if folded is not None:
        return folded, 1, 0
    return ("", 0, 0) if picture or INVISIBLE.match(ch) else ("?", 1, 1)


@lru_cache(4096)
def collapsed_run(run: str) -> str:
    return CELL if BREAK.search(run) else " " if SOLID.search(run) else ""


#: So many characters of a text that do not print as they are get replaced one by one.
FEW = 8


def normalize(text: str, printable: frozenset[str], known: dict[str, tuple[str, int, int]]) -> tuple[str, int, int]:
    """(text, visible characters, lost characters)."""
    plain = ANSI.sub("", text) if "\x1b" in text else text
    characters = {CELL, " ", *plain}
    runs_of = NEAR_RUNS if FAR.isdisjoint(characters) else ALL_RUNS
    collapsed = runs_of.sub(lambda m: collapsed_run(m[0]), plain).strip(EDGES)
    for ch in characters.difference(known):
        known[ch] = resolve(ch, printable)
    special = [(ch, *known[ch]) for ch in characters if known[ch] != (ch, 1, 0) and ch in collapsed]
    if len(special) > FEW:
        found = [known[ch] for ch in collapsed]
        shown, visible, lost = "".join(f[0] for f in found), sum(f[1] for f in found), sum(f[2] for f in found)
    else:
        shown, visible, lost = collapsed, len(collapsed), 0
        for ch, prints, seen, gone in special:  # what they print as is never special
            n = collapsed.count(ch)
            shown, visible, lost = shown.replace(ch, prints), visible - n * (1 - seen), lost + n * gone
    return SPACES.sub(" ", shown).strip(EDGES), visible, lost


def normalize_udf(printable: frozenset[str] = frozenset()):
    """text -> normalized text, visible and lost characters. ``printable``: characters that the fonts have."""

    @F.arrow_udf("struct<text:string,visible:bigint,lost:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        known: dict[str, tuple[str, int, int]] = {}

        def block(part: pa.Array) -> pa.Array:
            rows = [normalize(t or "", printable, known) for t in part.to_pylist()]
            return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["text", "visible", "lost"])

        return in_blocks(block, texts)

    return run


#: Characters that the native path does not know.
FOREIGN = f"[^\\x{{0}}-\\x{{FF}}\\x{{2500}}-\\x{{257F}}{CELL}{''.join([*PUNCTUATION, *STATUS_SIGNS])}]"


def normalize_routed(text: Column, printable: frozenset[str] = frozenset()) -> Column:
    """Normalized text of any script: native for texts that it knows all characters of; only the others travel to Python."""
    foreign = text.rlike(r"[\x{100}-\x{10FFFF}]") & text.rlike(FOREIGN)
    resolved = normalize_udf(printable).asNondeterministic()  # so that the optimizer does not copy the call into every use of the text
    return F.when(foreign, resolved(F.when(foreign, text))["text"]).otherwise(normalize_latin(text))


def renders_safely(stats: Column) -> Column:
    """At most a twentieth of the visible characters is lost."""
    return F.when(stats["visible"] > 0, 20 * stats["lost"] <= stats["visible"]).otherwise(F.lit(True))


def lost_share(stats: Column) -> Column:
    """The share of the visible characters that is lost; 0 where nothing is visible."""
    return F.when(stats["visible"] > 0, stats["lost"] / stats["visible"]).otherwise(F.lit(0.0))
