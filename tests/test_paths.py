import struct

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from sceneloom.sources import paths

number = st.floats(-1000, 1000, width=32)
operation = st.one_of(st.tuples(st.just("Z"), st.just([])), st.tuples(st.sampled_from("ML"), st.lists(number, min_size=2, max_size=2)), st.tuples(st.just("C"), st.lists(number, min_size=6, max_size=6)))


@given(st.lists(operation))
def test_round_trip(path):
    assert paths.decode_path(paths.encode_path(path)) == path


def test_unknown_byte_ends_a_path():
    assert paths.decode_path(paths.encode_path([("M", [1, 2])]) + b"\x09abc") == [("M", [1.0, 2.0])]
    assert paths.decode_path(b"\x01\x00") == [] and paths.decode_path(None) is None


def test_svg():
    assert paths.parse_svg_path("m1 2 3 4h5V1z") == [("M", [1, 2]), ("L", [4, 6]), ("L", [9, 6]), ("L", [9, 1]), ("Z", [])]
    assert paths.parse_svg_path("M0,0C1,1 2,2 3,0s2 2 3-1A1 1 0 0 0 5 5L1-1") == [
        ("M", [0, 0]), ("C", [1, 1, 2, 2, 3, 0]), ("C", [4, -2, 5, 2, 6, -1]), ("C", [7, -4, 7, 0, 6, -1]), ("L", [1, -1]),
    ]
    assert paths.parse_svg_path("M5 5 S 6 6 7 7") == [("M", [5, 5]), ("C", [10, 10, 6, 6, 7, 7])]
    assert paths.parse_svg_path("M0 0 Q 1 1 2 2 Z 3 3") == [("M", [0, 0]), ("L", [1, 1]), ("L", [2, 2]), ("Z", [])]


def test_in_batches(spark):
    rows = spark.createDataFrame([("M0 0L1 1Z",), (None,), ("",)], "d string").select(paths.decoded(paths.encoded_svg("d")).alias("back"), paths.parsed("d").alias("p")).collect()
    assert all(r["back"] == r["p"] for r in rows) and [r["p"] is None for r in rows] == [False, True, False]
    assert [o["op"] for o in rows[0]["p"]] == ["M", "L", "Z"]


def plain_path(blob: bytes | None) -> list[tuple[str, list[float]]] | None:
    """Operations of a path's bytes; an unknown or cut-off operation ends the path."""
    if blob is None:
        return None
    out, at = [], 0
    while at < len(blob) and blob[at] in paths.OPERATIONS:
        name, n = paths.OPERATIONS[blob[at]]
        if at + 1 + 4 * n > len(blob):
            break
        out.append((name, list(struct.unpack_from(f"<{n}f", blob, at + 1))))
        at += 1 + 4 * n
    return out


def plain_network(blob: bytes | None, scale_x: float = 1.0, scale_y: float = 1.0) -> list[tuple[str, list[float]]] | None:
    """Loops of a vector network as one path, scaled; each loop is closed. Null without any loop, or under 16 bytes.

    Segments that do not exist, or whose vertices do not, are passed over; region data may be cut off.
    """
    if blob is None or len(blob) < 16:
        return None
    n_vertices, n_segments, n_regions, _ = struct.unpack_from("<4I", blob)
    first = 16 + n_vertices * paths.VERTEX.itemsize
    vertices = np.frombuffer(blob, paths.VERTEX, n_vertices, 16)
    segments = np.frombuffer(blob, paths.SEGMENT, n_segments, first)
    points = np.stack([vertices["x"], vertices["y"]], 1).astype(float) * (scale_x, scale_y)
    rest = blob[first + n_segments * paths.SEGMENT.itemsize :]
    numbers, out = iter(np.frombuffer(rest, "<u4", len(rest) // 4).tolist()), []
    for _ in range(n_regions):
        for _ in range(next(numbers, 0)):
            count = next(numbers, None)
            if count is None:
                break
            for k in range(count):
                at = next(numbers, None)
                if at is None:
                    break
                if at >= n_segments or max(segments["a"][at], segments["b"][at]) >= n_vertices:
                    continue
                s = segments[at]
                a, b = points[s["a"]], points[s["b"]]
                if k == 0:
                    out.append(("M", a.tolist()))
                bend = [a + (float(s["ax"]) * scale_x, float(s["ay"]) * scale_y), b + (float(s["bx"]) * scale_x, float(s["by"]) * scale_y)] if s["kind"] != paths.STRAIGHT else []
                out.append(("C" if bend else "L", np.concatenate([*bend, b]).tolist()))
            out.append(("Z", []))
        next(numbers, None)
    return out or None


def read_back(flat):
    return [None if p is None else [(s["op"], s["args"]) for s in p] for p in paths._steps(flat).to_pylist()]


blobs = st.one_of(
    st.none(), st.binary(max_size=60), st.binary(max_size=60).map(lambda b: bytes(x % 5 for x in b)),
    st.lists(operation, max_size=12).map(paths.encode_path), st.tuples(st.lists(operation), st.binary(max_size=12)).map(lambda x: paths.encode_path(x[0]) + x[1]),
)


@given(st.lists(blobs), st.integers(0, 3))
def test_paths_of_a_batch(batch, skip):
    """A batch, also one that begins within another, gives what reading each byte string by itself does."""
    assert read_back(paths.decode_paths(pa.array(batch, pa.binary())[skip:])) == [plain_path(b) for b in batch[skip:]]


@given(st.lists(st.one_of(st.none(), st.lists(operation))))
def test_bytes_of_a_batch(batch):
    assert paths.encode_paths(paths.flat_paths(batch)).to_pylist() == [paths.encode_path(p) for p in batch]


@st.composite
def networks(draw):
    """Networks with segments and vertices that do not exist, and with cut-off regions."""
    small = st.integers(0, 4)
    vertices = draw(st.lists(st.tuples(number, number, small), max_size=4))
    segments = draw(st.lists(st.tuples(small, number, number, small, number, number, st.sampled_from([0, 4])), max_size=4))
    regions = draw(st.lists(st.lists(st.lists(small, max_size=4), max_size=3), max_size=3))
    words = [w for loops in regions for w in [len(loops), *(x for loop in loops for x in [len(loop), *loop]), 1]]
    head = struct.pack("<4I", len(vertices), len(segments), len(regions) + draw(st.integers(0, 1)), 1)
    tail = struct.pack(f"<{len(words)}I", *words)
    return head + np.array(vertices, paths.VERTEX).tobytes() + np.array(segments, paths.SEGMENT).tobytes() + tail[: len(tail) - draw(st.integers(0, min(len(tail), 9)))]


@given(st.lists(st.tuples(st.one_of(st.none(), networks(), st.binary(max_size=15)), st.floats(-3, 3, width=32), st.floats(-3, 3, width=32))))
def test_networks_of_a_batch(batch):
    x, y = (np.array([b[k] for b in batch], float) for k in (1, 2))
    assert read_back(paths.decode_networks(pa.array([b for b, _, _ in batch], pa.binary()), x, y)) == [plain_network(*b) for b in batch]


def test_networks_cut_before_their_regions():
    whole = paths.encode_network([[("M", [0.0, 0.0]), ("L", [3.0, 4.0]), ("Z", [])]])
    assert paths.decode_network(whole[:30]) is None
    assert paths.decode_network(struct.pack("<4I", 0, 0, 2**32 - 1, 0) + struct.pack("<I", 2**32 - 1)) is None


def test_long_path():
    path = [("M", [0.0, 0.0]), *(("L", [float(k), 1.0]) for k in range(200_000))]
    assert paths.decode_path(paths.encode_path(path)) == path
