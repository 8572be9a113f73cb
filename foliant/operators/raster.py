"""Pages as images: glyphs on a grid, ink by sentence, dim spans, a banner strip.

A page is first placed, which gives each printed character a cell and an ink, and then painted: every
glyph becomes an array of coverage, at its natural size or resampled to the cell, and is blended into
the canvas as one array operation. Glyphs are a bounded table that is broadcast; one Arrow function
paints a page at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from foliant.functions.cells import WIDE
from foliant.functions.text import CELL, DIM_OFF, DIM_ON
from foliant.session import importable
from foliant.sources import png

# Ink colours.
HUES = [(109, 2, 2), (109, 53, 2), (24, 109, 2), (2, 109, 109), (2, 32, 109), (75, 2, 109)]
BLACK, DIM, BAND = (0, 0, 0), (128, 128, 128), (255, 247, 194)
LARGEST = 16_384
#: All colours of a page without blending, and where they stand.
COLOURS = np.array([*HUES, BLACK, DIM, BAND, (255, 255, 255)], np.uint8)
BLACK_AT, DIM_AT, BAND_AT, WHITE_AT = range(len(HUES), len(HUES) + 4)
NUMBER = {tuple(int(v) for v in c): i for i, c in enumerate(COLOURS)}
MARK_ON, MARK_OFF, ENDS, AFTER = ord(DIM_ON), ord(DIM_OFF), [ord(c) for c in ".!?"], [ord(c) for c in f" {CELL}\n"]
WIDE_EDGES = np.array([edge for a, b in WIDE for edge in (a, b + 1)])
#: Least coverage of a resampled pixel that is painted, and cells between two columns.
FAINT, GUTTER = 0.02, 2
#: Pages whose images a task holds at a time.
BLOCK = 64

Glyphs = dict[int, tuple[int, int, int, int, list[int]]]
Ink = tuple[int, int, int]


@dataclass(frozen=True)
class Sheet:
    """How pages look: cells, page edge, copies of each line, ink, columns and whether glyphs are resampled to the cell."""

    cell_w: int
    cell_h: int
    size: int
    repeat: int = 1
    ink: str = "bw"
    columns: int = 1
    stretch: bool = False
    #: Rows of pixels above the base line in the glyphs' own cell; the cell's height where none is given.
    ascent: int | None = None

    @property
    def cols(self) -> int:
        whole = self.size // self.cell_w
        return (whole - GUTTER) // 2 if self.columns == 2 else whole

    @property
    def rows(self) -> int:
        return max(1, int((self.size - self.cell_h) / self.cell_h / self.repeat))


def width(ch: str) -> int:
    return 2 if any(a <= ord(ch) <= b for a, b in WIDE) else 1


def inked(text: str, ink: str, ends: str = "") -> Iterator[tuple[str, Ink]]:
    """Printed characters with their ink; ``ends`` stands for what follows the text."""
    sentence, dim = 0, False
    for k, ch in enumerate(text):
        if ch in (DIM_ON, DIM_OFF):
            dim = ch == DIM_ON
            continue
        following = text[k + 1 : k + 2] or ends
        if ch in ".!?" and following in (" ", CELL, "\n") and following:
            sentence += 1
        yield ch, BLACK if ch == CELL else DIM if dim else HUES[sentence % len(HUES)] if ink == "sent" else BLACK


def placed(text: str, sheet: Sheet) -> list[tuple[str, int, int, Ink]]:
    """(character, column, row, ink) of a page. A wide character never straddles a row; lines of a page of two columns are cut at its edge."""
    out, cols = [], sheet.cols
    if sheet.columns == 2:
        row = at = 0
        for ch, ink in inked(text, sheet.ink, " "):
            if ch == "\n":
                row, at = row + 1, 0
            elif row < 2 * sheet.rows and at >= 0:
                w = width(ch)
                if at + w > cols:
                    at = -1  # the rest of the line is beyond the edge
                    continue
                out.append((ch, at + (cols + GUTTER if row >= sheet.rows else 0), row % sheet.rows, ink))
                at += w
        return out
    at = 0
    for ch, ink in inked(text, sheet.ink):
        w = width(ch)
        at += w == 2 and cols >= 2 and at % cols == cols - 1
        if at + w > cols * sheet.rows:
            break
        out.append((ch, at % cols, at // cols, ink))
        at += w
    return out


def points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def cells(text: str, sheet: Sheet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, columns, rows and inks (as numbers of ``COLOURS``) of what ``placed`` gives, by arrays where all characters take one cell."""
    codes = points(text)
    shown = np.flatnonzero((codes != MARK_ON) & (codes != MARK_OFF))
    wide = len(codes) and codes.max() >= WIDE[0][0] and (np.searchsorted(WIDE_EDGES, codes[codes != ord(CELL)], "right") % 2).any()
    if sheet.columns == 2 or wide:
        found = placed(text, sheet)
        split = [np.array([f[i] for f in found], np.int64) for i in (1, 2)]
        return np.array([ord(f[0]) for f in found], np.int64), *split, np.array([NUMBER[f[3]] for f in found], np.uint8)
    at = np.arange(min(len(shown), sheet.cols * sheet.rows)) if sheet.cols else np.zeros(0, np.int64)
    shown = shown[: len(at)]
    marks = np.maximum.accumulate(np.where(codes == MARK_ON, 2, np.where(codes == MARK_OFF, 1, 0)) + 3 * np.arange(1, len(codes) + 1) * ((codes == MARK_ON) | (codes == MARK_OFF)))
    inks = np.full(len(codes), BLACK_AT, np.int64)
    if sheet.ink == "sent":
        ends = np.zeros(len(codes), bool)
        ends[:-1] = np.isin(codes[:-1], ENDS) & np.isin(codes[1:], AFTER)
        inks = np.cumsum(ends) % len(HUES)
    inks = np.where(codes == ord(CELL), BLACK_AT, np.where(marks % 3 == 2, DIM_AT, inks))
    return codes[shown], at % max(1, sheet.cols), at // max(1, sheet.cols), inks[shown].astype(np.uint8)


def bitmap(glyph: tuple[int, int, int, int, list[int]]) -> np.ndarray:
    """Coverage of a glyph at its natural size, 0 or 1."""
    w, h, _, _, rows = glyph
    bits = np.array(rows[:h], np.int64).reshape(-1, 1) >> (7 - np.arange(w)) & 1 if w <= 8 else np.zeros((0, 0), np.int64)
    return bits.astype(np.float64)


def resampled(bits: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear resampling to ``h`` by ``w``; pixels outside the glyph are empty, faint ones too."""
    source_h, source_w = bits.shape
    edge = np.pad(bits, 1)
    y, x = (np.arange(h) + 0.5) * source_h / h - 0.5, (np.arange(w) + 0.5) * source_w / w - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: edge[np.ix_(y0 + 1 + i, x0 + 1 + j)]
    mixed = (at(0, 0) * (1 - wx) + at(0, 1) * wx) * (1 - wy) + (at(1, 0) * (1 - wx) + at(1, 1) * wx) * wy
    return np.where(mixed > FAINT, np.floor(mixed * 255 + 0.5) / 255, 0.0)


def blend(canvas: np.ndarray, coverage: np.ndarray, x: int, y: int, ink: Ink) -> None:
    """Mix ``ink`` into the canvas at (x, y) by coverage; what lies outside is clipped."""
    top, left = max(0, y), max(0, x)
    bottom, right = min(canvas.shape[0], y + coverage.shape[0]), min(canvas.shape[1], x + coverage.shape[1])
    if top >= bottom or left >= right:
        return
    a = coverage[top - y : bottom - y, left - x : right - x, None]
    under = canvas[top:bottom, left:right]
    canvas[top:bottom, left:right] = np.floor(under * (1 - a) + np.array(ink, np.float64) * a + 0.5).astype(np.uint8)


class Painter:
    """Paints pages of one look; remembers the pixels of glyphs.

    All characters of a page are painted by one array operation. Pixels of unsampled glyphs are covered whole or not at all, so
    such a page is painted in numbers of colours, later characters over earlier ones; resampled glyphs fill their own
    cell only, so no pixel of such a page is blended twice.
    """

    def __init__(self, sheet: Sheet, glyphs: Glyphs):
        if not 0 < sheet.size <= LARGEST:
            raise ValueError("page edge out of range")
        self.sheet, self.glyphs = sheet, glyphs
        self.known: dict[int, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.table: tuple[np.ndarray, ...] | None = None

    def shape(self, code: int) -> tuple[np.ndarray, int, int] | None:
        """Coverage of a character and where it goes in its cell; None where the font lacks it."""
        sheet = self.sheet
        if code == ord(CELL):
            return np.ones((sheet.cell_h, sheet.cell_w)), 0, 0
        glyph = self.glyphs.get(code)
        if glyph is None or not glyph[4]:
            return None
        if sheet.stretch:
            return resampled(bitmap(glyph), sheet.cell_w, sheet.cell_h), 0, 0
        _, h, xoff, yoff, _ = glyph
        return bitmap(glyph), xoff, 0 if sheet.ascent is None else sheet.ascent - h - yoff

    def number(self, code: int) -> int:
        """Where a character's pixels stand in the table."""
        if code not in self.known:
            self.known[code], self.table, found = len(self.parts), None, self.shape(code)
            if found is None:
                self.parts.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
            else:
                y, x = np.nonzero(found[0])
                self.parts.append((y + found[2], x + found[1], found[0][y, x]))
        return self.known[code]

    def covered(self, codes: np.ndarray, x: np.ndarray, y: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pixels of characters at (x, y) in order: their places in the canvas, which character each is of, and coverage."""
        distinct, which = np.unique(codes, return_inverse=True)
        numbers = np.array([self.number(int(c)) for c in distinct], np.int64)[which]
        if self.table is None:
            sizes = np.array([len(p[0]) for p in self.parts], np.int64)
            self.table = (sizes, np.cumsum(sizes) - sizes, *(np.concatenate(c) for c in zip(*self.parts)))
        sizes, starts, ys, xs, coverage = self.table
        n = sizes[numbers]
        of = np.repeat(np.arange(len(codes)), n)
        at = np.arange(len(of)) + np.repeat(starts[numbers] - (np.cumsum(n) - n), n)
        py, px = ys[at] + y[of], xs[at] + x[of]
        inside = (py >= 0) & (py < height) & (px >= 0) & (px < self.sheet.size)
        if not inside.all():
            py, px, of, at = py[inside], px[inside], of[inside], at[inside]
        return py * self.sheet.size + px, of, coverage[at]

    def drawn(self, text: str, banner: str = "") -> tuple[np.ndarray, int]:
        """A page as numbers of ``COLOURS``, or in pixels where glyphs are resampled, and how many characters it printed."""
        sheet = self.sheet
        codes, cols, rows, inks = cells(text, sheet)
        used = int(rows.max()) + 1 if len(rows) else 1
        height = (1 + used * sheet.repeat) * sheet.cell_h
        canvas = np.full((height, sheet.size, 3), 255, np.uint8) if sheet.stretch else np.full((height, sheet.size), WHITE_AT, np.uint8)
        flat = canvas.reshape(-1, 3) if sheet.stretch else canvas.reshape(-1)

        def put(codes: np.ndarray, x: np.ndarray, y: np.ndarray, inks: np.ndarray) -> None:
            if len(codes):
                where, of, coverage = self.covered(codes, x, y, height)
                if sheet.stretch:
                    a, ink = coverage[:, None], COLOURS[inks[of]].astype(np.float64)
                    flat[where] = np.floor(flat[where] * (1 - a) + ink * a + 0.5).astype(np.uint8)
                else:
                    flat[where] = inks[of]

        head = points(banner[: sheet.size // sheet.cell_w])
        at = np.flatnonzero((head >= 32) & (head < 127))
        put(head[at], at * sheet.cell_w, np.zeros(len(at), np.int64), np.full(len(at), BLACK_AT, np.uint8))
        for row in range(used if sheet.repeat > 1 else 0):
            canvas[(2 + row * sheet.repeat) * sheet.cell_h : (1 + (row + 1) * sheet.repeat) * sheet.cell_h] = BAND if sheet.stretch else BAND_AT
        each = np.repeat(np.arange(len(codes)), sheet.repeat)
        copies = np.tile(np.arange(sheet.repeat), len(codes))
        put(codes[each], cols[each] * sheet.cell_w, (1 + rows[each] * sheet.repeat + copies) * sheet.cell_h, inks[each])
        return canvas, len(codes)

    def page(self, text: str, banner: str = "") -> tuple[np.ndarray, int]:
        """Pixels of a page and how many characters it printed; the page is as high as the rows it uses."""
        canvas, n = self.drawn(text, banner)
        return canvas if self.sheet.stretch else COLOURS[canvas], n

    def image(self, text: str, banner: str = "") -> tuple[bytes, int, int]:
        """A page as PNG, its height and how many characters it printed."""
        canvas, n = self.drawn(text, banner)
        return png.encode(canvas) if self.sheet.stretch else png.encode_indexed(canvas, COLOURS), canvas.shape[0], n


def paint(text: str, glyphs: Glyphs, cell_w: int, cell_h: int, size: int, repeat: int = 1, ink: str = "bw", banner: str = "") -> tuple[np.ndarray, int]:
    """One page of a grid."""
    return Painter(Sheet(cell_w, cell_h, size, repeat, ink), glyphs).page(text, banner)


def page_udf(spark: SparkSession, glyphs: Glyphs, sheet: Sheet):
    """(text, banner) -> png, rows of pixels, printed characters."""
    sent = spark.sparkContext.broadcast(glyphs)

    @F.arrow_udf("struct<png:binary,height:int,chars:bigint>")
    def page(texts: pa.Array, banners: pa.Array) -> pa.Array:
        painter = Painter(sheet, sent.value)
        made = [painter.image(text or "", banner or "") for text, banner in zip(texts.to_pylist(), banners.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int64())], names=["png", "height", "chars"])

    return page


def painted(pages: DataFrame, glyphs: Glyphs, sheets: dict[str, Sheet]) -> DataFrame:
    """``pages`` (sheet: a key of ``sheets``, text, banner and other columns) with png, height and chars in place of text and banner.

    Images leave in blocks of ``BLOCK`` pages, so a task holds few of them at a time. Few bytes of text are much
    work: deal pages out (``session.spread``) first.
    """
    sent = importable(pages.sparkSession).sparkContext.broadcast((glyphs, sheets))
    kept = [f for f in pages.schema if f.name not in ("text", "banner")]
    schema = StructType([*kept, StructField("png", BinaryType()), StructField("height", IntegerType()), StructField("chars", LongType())])

    def paint_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, looks = sent.value
        painters = {name: Painter(sheet, found) for name, sheet in looks.items()}
        for batch in batches:
            for part in (batch.slice(at, BLOCK) for at in range(0, len(batch), BLOCK)):
                made = [painters[s].image(text or "", banner or "") for s, text, banner in zip(*(part[c].to_pylist() for c in ("sheet", "text", "banner")))]
                new = [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part[f.name] for f in kept), *new], names=schema.names)

    return pages.mapInArrow(paint_blocks, schema)


def test_glyphs() -> Glyphs:
    """A small made-up 8x8 font: every Latin-1 character shows the bits of its code."""
    return {cp: (8, 8, 0, -1, [0, cp, cp, 0, ~cp & 0xFF, cp, cp, 0]) for cp in range(32, 256)}
