"""PNG images of indexed pixels, in 1, 2, 4 or 8 bits each as their colours need, or of RGB pixels, and their decoding for checks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """(height, width, 3) uint8 pixels: indexed in order of first use when 256 colours suffice, else RGB."""
    height, width, _ = pixels.shape
    packed = pixels.astype(np.uint32) @ np.array([65536, 256, 1], np.uint32)
    colours, first, where = np.unique(packed.reshape(-1), return_index=True, return_inverse=True)
    if len(colours) <= 256:
        order = np.argsort(first)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        body, kind = rank[where.reshape(-1)].astype(np.uint8).reshape(height, width), 3
        palette = b"".join(struct.pack(">I", int(c))[1:] for c in colours[order])
    else:
        body, kind, palette = pixels.reshape(height, width * 3), 2, b""
    return _file(width, height, kind, palette, body)


def encode_indexed(numbers: np.ndarray, colours: np.ndarray) -> bytes:
    """The same image from (height, width) uint8 numbers of rows of ``colours``, which differ from each other."""
    flat = numbers.reshape(-1)
    used = np.flatnonzero(np.bincount(flat, minlength=len(colours)))
    order = sorted((int(np.argmax(flat == c)), c) for c in used)
    rank = np.zeros(len(colours), np.uint8)
    rank[[c for _, c in order]] = np.arange(len(order))
    return _file(numbers.shape[1], numbers.shape[0], 3, b"".join(colours[c].tobytes() for _, c in order), rank[numbers])


def _packed(body: np.ndarray, depth: int) -> np.ndarray:
    """Rows of numbers below ``2 ** depth``, the first of a byte in its high bits; the last byte is filled up with zeros."""
    if depth == 1:
        return np.packbits(body, axis=1)
    each = 8 // depth
    whole = np.pad(body, ((0, 0), (0, -body.shape[1] % each)))
    packed = np.zeros((len(body), whole.shape[1] // each), np.uint8)
    for i in range(each):
        packed |= whole[:, i::each] << np.uint8(8 - depth * (i + 1))
    return packed


def _file(width: int, height: int, kind: int, palette: bytes, body: np.ndarray) -> bytes:
    depth = next(d for d in (1, 2, 4, 8) if len(palette) // 3 <= 1 << d) if kind == 3 else 8
    rows = np.concatenate([np.zeros((height, 1), np.uint8), _packed(body, depth) if depth < 8 else body], 1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + (_chunk(b"PLTE", palette) if palette else b"") + _chunk(b"IDAT", zlib.compress(rows, 9)) + _chunk(b"IEND", b"")


def decode(png: bytes) -> np.ndarray:
    """Pixels of an image that ``encode`` made."""
    if not png.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, found = len(SIGNATURE), {}
    while at < len(png):
        (size,) = struct.unpack(">I", png[at : at + 4])
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError(f"damaged chunk {kind!r}")
        found[kind] = data
        at += 12 + size
    width, height, depth, kind = struct.unpack(">IIBB", found[b"IHDR"][:10])
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, -1)[:, 1:]
    if kind == 2:
        return rows.reshape(height, width, 3)
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
    return np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3)[bits @ (1 << np.arange(depth)[::-1])]
