"""Cell counts, pages and line wrapping.

A character takes one cell, a wide one two, an ink mark none. Texts without wide characters and marks
are paginated by substring; the others go through an Arrow function of one fold per text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.batches import in_blocks
from foliant.functions.text import DIM_OFF, DIM_ON, MARKS

# Inclusive code point ranges of two-cell characters.
WIDE = [
    (0x1100, 0x115F), (0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0x3000, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF),
    (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x20000, 0x2FFFD), (0x30000, 0x3FFFD),
]
# Ranges that count as ideographic when a shape is chosen.
IDEOGRAPHIC = [(0x2E80, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFF00, 0xFF60)]


def char_class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def cell_length(text: Column, wide_cells: bool = True) -> Column:
    plain = F.length(F.translate(text, MARKS, ""))
    return plain + F.regexp_count(text, F.lit(char_class(WIDE))) if wide_cells else plain


def is_ideographic(text: Column) -> Column:
    """At least eight ideographs that are a quarter or more of what is visible."""
    visible = F.regexp_replace(text, r"[ █\p{Cc}\p{Mn}\p{Me}]", "")
    wide = F.regexp_count(visible, F.lit(char_class(IDEOGRAPHIC)))
    return (wide >= 8) & (4 * wide >= F.length(visible))


def narrow_pages(text: Column, capacity: Column) -> Column:
    """Contiguous pages of ``capacity`` characters: for texts of one-cell characters only."""
    count = F.ceil(F.length(text) / capacity).cast("int")
    pages = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, (i * capacity + 1).cast("int"), capacity.cast("int")))
    return F.when(F.length(text) > 0, pages).otherwise(F.array().cast("array<string>"))


def _width(ch: str, wide_cells: bool) -> int:
    if ch in (DIM_ON, DIM_OFF):
        return 0
    return 2 if wide_cells and any(a <= ord(ch) <= b for a, b in WIDE) else 1


@lru_cache(2)
def widths(wide_cells: bool) -> np.ndarray:
    """Cells by code point."""
    table = np.ones(0x110000, np.uint8)
    table[[ord(m) for m in MARKS]] = 0
    for a, b in WIDE if wide_cells else []:
        table[a : b + 1] = 2
    return table


#: Characters that do not take one cell.
MARKED = re.compile(f"[{MARKS}]")
UNEVEN = re.compile(f"[{MARKS}{''.join(f'{chr(a)}-{chr(b)}' for a, b in WIDE)}]")


def reach(ends: memoryview, start: int, cells: int) -> int:
    """How far so many cells go from ``start``, with the marks behind them."""
    near = min(len(ends), start + cells + 2)
    stop = near if ends[near - 1] > ends[start] + cells else len(ends)
    return bisect_right(ends, ends[start] + cells, start, stop) - 1


def cut_pages(text: str, capacity: int, cols: int, wide_cells: bool) -> list[str]:
    """Pages of a text; a wide character never straddles a row, marks stay on the page before.

    ``ends`` counts the cells before each character, so a row, or a page without wide characters, is one step.
    """
    if not (UNEVEN if wide_cells else MARKED).search(text):
        step = max(1, capacity)
        return [text[i : i + step] for i in range(0, len(text), step)]
    cells = widths(wide_cells)[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    ends, wide = (memoryview(np.concatenate([[0], np.cumsum(c, dtype=np.int64)])) for c in (cells, cells == 2))
    rows, rest = divmod(capacity, cols) if cols >= 2 else (0, capacity)
    pages, start, n = [], 0, len(text)
    while ends[n] > ends[start]:
        stop = reach(ends, start, capacity)
        if wide[stop] > wide[start] or (stop < n and ends[stop] - ends[start] < capacity):
            stop = start
            for _ in range(rows):
                stop = reach(ends, stop, cols)
            stop = reach(ends, stop, rest)
        if ends[stop] == ends[start]:  # a page takes a character even where that is wider
            first = bisect_right(ends, ends[start], start)
            stop = reach(ends, start, ends[first] - ends[start])
        pages.append(text[start:stop])
        start = stop
    return pages


#: Words whose characters take one cell each.
PLAIN = re.compile(r"[\x20-\x7e\xa0-\xff]+")


def wrap_lines(text: str, width: int, wide_cells: bool) -> list[str]:
    """Greedy word wrap; words longer than a line are split hard."""
    lines, line, used = [], "", 0
    for word in (w for w in re.split(r"\s+", text) if w):
        size = len(word) if PLAIN.fullmatch(word) else sum(_width(c, wide_cells) for c in word)
        if line and used + 1 + size <= width:
            line, used = f"{line} {word}", used + 1 + size
            continue
        if line:
            lines.append(line)
            line, used = "", 0
        while size > width:
            piece, cells = "", 0
            for c in word:
                if piece.strip(MARKS) and cells + _width(c, wide_cells) > width:
                    break
                piece, cells = piece + c, cells + _width(c, wide_cells)
            lines.append(piece)
            word, size = word[len(piece) :], size - cells
        line, used = word, size
    return [*lines, line] if line else lines


def pages_udf(wide_cells: bool = True):
    """(text, capacity, cols) -> pages, for any text."""

    @F.arrow_udf("array<string>")
    def pages(texts: pa.Array, capacities: pa.Array, cols: pa.Array) -> pa.Array:
        def block(*part: pa.Array) -> pa.Array:
            found = [None if t is None else cut_pages(t, int(n), int(c), wide_cells) for t, n, c in zip(*[p.to_pylist() for p in part])]
            return pa.array(found, pa.list_(pa.string()))

        return in_blocks(block, texts, capacities, cols)

    return pages


def lines_udf(width: int, wide_cells: bool = True):
    @F.arrow_udf("array<string>")
    def lines(texts: pa.Array) -> pa.Array:
        return in_blocks(lambda part: pa.array([None if t is None else wrap_lines(t, width, wide_cells) for t in part.to_pylist()], pa.list_(pa.string())), texts)

    return lines


def doc_pages(lines: Column, rows: int) -> Column:
    """Pages of two columns of ``rows`` lines."""
    count = F.ceil(F.size(lines) / (2 * rows)).cast("int")
    pages = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(lines, i * (2 * rows) + 1, F.lit(2 * rows)), "\n"))
    return F.when(F.size(lines) > 0, pages).otherwise(F.array().cast("array<string>"))
