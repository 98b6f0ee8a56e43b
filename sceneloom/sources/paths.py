"""Vector paths: SVG path data, and the byte form that documents keep them in.

Byte form: an operation byte and little-endian 32-bit floats. Bytes are read and written for a whole Arrow batch at once, as
numpy arrays; path data is read text by text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operation bytes, with the number of coordinates that follow.
OPERATIONS = {0: ("Z", 0), 1: ("M", 2), 2: ("L", 2), 4: ("C", 6)}
BYTES = {name: (byte, n) for byte, (name, n) in OPERATIONS.items()}
PATH = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("args", T.ArrayType(T.DoubleType()))]))

_TOKEN = re.compile(r"[MLCSHVZmlcshvz]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Z": 0}


def decode_path(blob: bytes | None) -> list[tuple[str, list[float]]] | None:
    """Operations of a path's bytes; an unknown or cut-off operation ends the path."""
    return _of_one(decode_paths, [blob])


def encode_path(path: list[tuple[str, list[float]]] | None, scale: float = 1.0) -> bytes | None:
    """Bytes of M, L, C and Z operations with absolute coordinates, scaled."""
    if path is None:
        return None
    return b"".join(struct.pack(f"<B{BYTES[op][1]}f", BYTES[op][0], *(a * scale for a in args)) for op, args in path)


def parse_svg_path(text: str | None) -> list[tuple[str, list[float]]] | None:
    """Path data as absolute M, L, C and Z.

    Coordinates that repeat a move's are lines. A smooth curve mirrors the last control point seen anywhere
    in the path, 0,0 before any. Letters of other commands (Q, T, A) are not seen: their numbers go on
    as points of the command before. Numbers before any command, after a close, and too few for a point are left out.
    """
    if text is None:
        return None
    out, here, begin, control = [], (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)
    tokens = _TOKEN.findall(text)
    at = 0
    while at < len(tokens):
        command = tokens[at]
        at += 1
        numbers = []
        while at < len(tokens) and not tokens[at].isalpha():
            numbers.append(float(tokens[at]))
            at += 1
        kind = command.upper()
        if kind == "Z":
            out.append(("Z", []))
            here = begin
        n = _TAKES.get(kind, 0)
        for k in range(len(numbers) // n if n else 0):
            x0, y0 = here if command.islower() else (0.0, 0.0)
            part = numbers[k * n : (k + 1) * n]
            if kind == "H":
                points = [(x0 + part[0], here[1])]
            elif kind == "V":
                points = [(here[0], y0 + part[0])]
            else:
                points = [(x0 + part[i], y0 + part[i + 1]) for i in range(0, n, 2)]
            if kind == "S":
                points = [(2 * here[0] - control[0], 2 * here[1] - control[1]), *points]
            op = "C" if len(points) == 3 else "M" if kind == "M" and k == 0 else "L"
            out.append((op, [c for p in points for c in p]))
            here = points[-1]
            begin = here if op == "M" else begin
            control = points[1] if op == "C" else control
    return out


#: Records of a vector network. After four counts (vertices, segments, regions, styles) come
#: vertices, segments, and for each region its loops (counted segment numbers) and a winding rule.
VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("mirroring", "<u4")])
SEGMENT = np.dtype([("a", "<u4"), ("ax", "<f4"), ("ay", "<f4"), ("b", "<u4"), ("bx", "<f4"), ("by", "<f4"), ("kind", "<u4")])
STRAIGHT, CURVED, MIRRORING, NONZERO = 0, 4, 4, 1


def decode_network(blob: bytes | None, scale_x: float = 1.0, scale_y: float = 1.0) -> list[tuple[str, list[float]]] | None:
    """Loops of a vector network as one path, scaled; each loop is closed. Null without any loop, under 16 bytes, or
    if the vertices or segments are cut off.

    Segments that do not exist, or whose vertices do not, are passed over; region data may be cut off.
    """
    return _of_one(decode_networks, [blob], np.array([scale_x]), np.array([scale_y]))


def encode_network(loops: list[list[tuple[str, list[float]]]]) -> bytes:
    """A vector network with one region of one loop for each path of M, L, C and Z. Closing adds a segment only away from the start."""
    vertices, segments, regions = [], [], []
    for path in loops:
        own, start, here = [], None, None
        for op, args in path:
            if op == "Z":
                to = start
            else:
                to = len(vertices)
                vertices.append((args[-2], args[-1], MIRRORING))
            if op == "M":
                start = to
            elif here is not None and to is not None and not (op == "Z" and here == start):
                a, b = vertices[here], vertices[to]
                bend = (args[0] - a[0], args[1] - a[1], args[2] - b[0], args[3] - b[1]) if op == "C" else (0, 0, 0, 0)
                own.append(len(segments))
                segments.append((here, *bend[:2], to, *bend[2:], CURVED if op == "C" else STRAIGHT))
            here = to
        regions.append(struct.pack(f"<{len(own) + 3}I", 1, len(own), *own, NONZERO))
    head = struct.pack("<4I", len(vertices), len(segments), len(regions), 1)
    return b"".join([head, np.array(vertices, VERTEX).tobytes(), np.array(segments, SEGMENT).tobytes(), *regions])


# Batches -----------------------------------------------------------------------------------------

_CODES = np.array(list(OPERATIONS), np.uint8)
_NAMES = pa.array([name for name, _ in OPERATIONS.values()])
_STEP = np.zeros(256, np.int64)  # bytes of an operation by its first byte; 0: there is none
_STEP[_CODES] = [1 + 4 * n for _, n in OPERATIONS.values()]


class Flat(NamedTuple):
    """Paths of a batch: operation bytes and coordinates one after the other, the first operation of each path, and which paths are null."""

    ops: np.ndarray
    values: np.ndarray
    off: np.ndarray
    null: np.ndarray


def _buffer(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of bytes; null counts as empty."""
    col = pc.fill_null(blobs.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _records(data: np.ndarray, at: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Records of a type that begin at places of data."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(kind.itemsize)]).view(kind).reshape(-1)


def _places(first: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
    """first, first + step, ... of each row, `count` of them."""
    return np.repeat(first - step * (np.cumsum(count) - count), count) + step * np.arange(count.sum())


def decode_paths(blobs: pa.Array) -> Flat:
    """Paths of a batch of byte strings.

    Each byte knows where the operation after it would begin, if it began one itself; jumps of doubled length mark
    the bytes that the paths' starts reach, so a path of n operations takes log2(n) rounds over the batch.
    """
    data, off = _buffer(blobs)
    n = len(data)
    end = np.repeat(off[1:], np.diff(off))
    after = np.arange(n) + _STEP[data]
    whole = (_STEP[data] > 0) & (after <= end)
    jump = np.append(np.where(whole & (after < end), after, n), n)
    reached = np.zeros(n + 1, bool)
    reached[off[:-1][off[:-1] < off[1:]]] = True
    while not reached[new := jump[np.flatnonzero(reached)]].all():
        reached[new] = True
        jump = jump[jump]
    at = np.flatnonzero(reached[:n] & whole)
    size = (_STEP[data[at]] - 1) // 4
    values = _records(data, _places(at + 1, size, 4), np.dtype("<f4")).astype(float)
    return Flat(data[at], values, np.searchsorted(at, off), blobs.is_null().to_numpy(zero_copy_only=False))


def decode_networks(blobs: pa.Array, scale_x: np.ndarray, scale_y: np.ndarray) -> Flat:
    """Paths of a batch of vector networks: loops are counted one by one, their segments read all at once."""
    data, off = _buffer(blobs)
    size = np.diff(off)
    there = np.flatnonzero(size >= 16)
    counts = np.zeros((len(size), 4), np.int64)  # vertices, segments, regions, styles
    counts[there] = _records(data, _places(off[there], np.full(len(there), 4), 4), np.dtype("<u4")).reshape(-1, 4)
    rest = off[:-1] + 16 + counts[:, 0] * VERTEX.itemsize + counts[:, 1] * SEGMENT.itemsize
    owner, first, length = [], [], []
    for k in there[rest[there] <= off[there + 1]].tolist():
        numbers = np.frombuffer(data[rest[k] : off[k + 1]], "<u4", (off[k + 1] - rest[k]) // 4)
        at, n_regions = 0, counts[k, 2]
        while n_regions and at < len(numbers):
            loops, at = int(numbers[at]), at + 1
            while loops and at < len(numbers):
                n = min(int(numbers[at]), len(numbers) - at - 1)
                owner.append(k), first.append(rest[k] + 4 * (at + 1)), length.append(n)
                at, loops = at + 1 + n, loops - 1
            at, n_regions = at + 1, n_regions - 1  # the winding rule
    owner, first, length = (np.array(x, np.int64) for x in (owner, first, length))
    loop = np.repeat(np.arange(len(owner)), length)
    nth = _places(np.zeros_like(length), length, 1)
    number = _records(data, _places(first, length, 4), np.dtype("<u4")).astype(np.int64)
    keep = number < counts[owner[loop], 1]
    loop, nth, number = loop[keep], nth[keep], number[keep]
    k = owner[loop]
    segment = _records(data, off[k] + 16 + counts[k, 0] * VERTEX.itemsize + number * SEGMENT.itemsize, SEGMENT)
    keep = np.maximum(segment["a"], segment["b"]) < counts[k, 0]
    loop, nth, segment, k = loop[keep], nth[keep], segment[keep], k[keep]
    scale = np.stack([scale_x, scale_y], 1)[k]

    def point(end: str) -> np.ndarray:
        vertex = _records(data, off[k] + 16 + segment[end].astype(np.int64) * VERTEX.itemsize, VERTEX)
        return np.stack([vertex["x"], vertex["y"]], 1).astype(float) * scale

    def bend(end: str) -> np.ndarray:
        return np.stack([segment[f"{end}x"], segment[f"{end}y"]], 1).astype(float) * scale

    a, b = point("a"), point("b")
    curved = (segment["kind"] != STRAIGHT)[:, None]
    lines = np.where(curved, np.concatenate([a + bend("a"), b + bend("b"), b], 1), np.concatenate([b, a, a], 1))
    begins, closes = np.flatnonzero(nth == 0), np.arange(len(owner))
    ops = np.concatenate([np.full(len(begins), BYTES["M"][0]), np.where(curved[:, 0], BYTES["C"][0], BYTES["L"][0]), np.full(len(closes), BYTES["Z"][0])]).astype(np.uint8)
    values = np.concatenate([np.concatenate([a[begins]] * 3, 1), lines, np.zeros((len(closes), 6))])
    of, place = np.concatenate([loop[begins], loop, closes]), np.concatenate([nth[begins] - 1, nth, np.full(len(closes), 1 << 40)])
    order = np.lexsort((place, of))
    ops, values = ops[order], values[order][np.arange(6) < ((_STEP[ops[order]] - 1) // 4)[:, None]]
    starts = np.searchsorted(owner[of[order]], np.arange(len(size) + 1))
    return Flat(ops, values, starts, np.diff(starts) == 0)


def flat_paths(paths: list[list[tuple[str, list[float]]] | None]) -> Flat:
    """Paths as a batch."""
    count = np.array([len(p or ()) for p in paths], np.int64)
    every = [step for p in paths for step in p or ()]
    ops = np.array([BYTES[op][0] for op, _ in every], np.uint8)
    values = np.fromiter((x for _, args in every for x in args), float)
    return Flat(ops, values, np.concatenate([[0], np.cumsum(count)]), np.array([p is None for p in paths], bool))


def encode_paths(flat: Flat) -> pa.Array:
    """Byte form of the paths of a batch; numbers beyond 32-bit floats are infinite."""
    size = _STEP[flat.ops]
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(begin[-1], np.uint8)
    data[begin[:-1]] = flat.ops
    with np.errstate(over="ignore"):
        numbers = flat.values.astype("<f4").view(np.uint8).reshape(-1, 4)
    data[_places(begin[:-1] + 1, (size - 1) // 4, 4)[:, None] + np.arange(4)] = numbers
    out = pa.Array.from_buffers(pa.large_binary(), len(flat.null), [None, pa.py_buffer(begin[flat.off]), pa.py_buffer(data)])
    return pc.if_else(pa.array(flat.null), None, out).cast(pa.binary())


def _steps(flat: Flat) -> pa.Array:
    """The paths of a batch as lists of operations."""
    names = _NAMES.take(pa.array(np.searchsorted(_CODES, flat.ops)))
    edges = np.concatenate([[0], np.cumsum((_STEP[flat.ops] - 1) // 4)])
    args = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat.values, pa.float64()))
    steps = pa.StructArray.from_arrays([names, args], names=["op", "args"])
    return pa.ListArray.from_arrays(pa.array(flat.off, pa.int32()), steps, mask=pa.array(flat.null))


def _of_one(decode: Callable[..., Flat], blobs: list[bytes | None], *more) -> list[tuple[str, list[float]]] | None:
    steps = _steps(decode(pa.array(blobs, pa.binary()), *more))[0].as_py()
    return None if steps is None else [(s["op"], s["args"]) for s in steps]


@F.arrow_udf(PATH)
def decoded(blob: pa.Array) -> pa.Array:
    return _steps(decode_paths(blob))


@F.arrow_udf(PATH)
def parsed(text: pa.Array) -> pa.Array:
    return _steps(flat_paths([parse_svg_path(t) for t in text.to_pylist()]))


@F.arrow_udf(T.BinaryType())
def encoded_svg(text: pa.Array) -> pa.Array:
    return encode_paths(flat_paths([parse_svg_path(t) for t in text.to_pylist()]))


@F.pandas_udf(T.BinaryType())
def encoded_network(text: pd.Series) -> pd.Series:
    """Path data as a vector network of one loop."""
    return pd.Series([None if t is None else encode_network([parse_svg_path(t)]) for t in text], dtype=object)


@F.arrow_udf(PATH)
def decoded_network(blob: pa.Array, scale_x: pa.Array, scale_y: pa.Array) -> pa.Array:
    scales = (s.cast(pa.float64()).to_numpy(zero_copy_only=False) for s in (scale_x, scale_y))
    return _steps(decode_networks(blob, *scales))
