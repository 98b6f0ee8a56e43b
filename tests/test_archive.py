import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sceneloom.sources import archive, paths, records

SCHEMA = {
    "NodeType": ("ENUM", [("SLIDE", None, False, 1), ("TEXT", None, False, 2)]),
    "GUID": ("STRUCT", [("sessionID", "uint", False, 0), ("localID", "uint", False, 0)]),
    "Parent": ("STRUCT", [("guid", "GUID", False, 0), ("position", "string", False, 0)]),
    "Text": ("MESSAGE", [("characters", "string", False, 1)]),
    "Node": ("MESSAGE", [("guid", "GUID", False, 1), ("parentIndex", "Parent", False, 2), ("type", "NodeType", False, 3), ("name", "string", False, 4), ("opacity", "float", False, 5), ("textData", "Text", False, 6), ("hash", "byte", True, 7), ("visible", "bool", False, 8), ("big", "int64", False, 9)]),
    "Message": ("MESSAGE", [("nodeChanges", "Node", True, 1)]),
}
NODES = [
    {"guid": {"sessionID": 0, "localID": 1}, "type": "SLIDE", "name": "Ä", "opacity": 0.5, "visible": False},
    {"guid": {"sessionID": 4294967295, "localID": 2}, "parentIndex": {"guid": {"sessionID": 0, "localID": 1}, "position": "!"}, "type": "TEXT", "textData": {"characters": "hello\nworld"}, "hash": b"\x00\xff", "big": -(2**62)},
]


def canvas_parts():
    message = records.encode({"nodeChanges": NODES}, SCHEMA, "Message")
    chunk = lambda kind, ix, b: (kind, ix, archive.CANVAS, "fig-deck", 48, b)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    return [chunk("schema", 0, records.write_schema(SCHEMA)), chunk("message", 1, message), chunk("chunk", 2, b"\x01\x02"), ("image", 0, "images/ab", None, None, png), ("meta", 1, "meta.json", None, None, b"{}")]


def test_schema_round_trip():
    assert records.read_schema(records.write_schema(SCHEMA)) == SCHEMA
    assert records.decode(records.encode({"nodeChanges": NODES}, SCHEMA, "Message"), SCHEMA, "Message") == {"nodeChanges": NODES}


@given(st.integers(0, 2**32 - 1), st.integers(-(2**31), 2**31 - 1), st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**64 - 1), st.floats(width=32, allow_nan=False), st.text().filter(lambda t: "\0" not in t))
def test_numbers(u, i, big, ubig, x, text):
    for kind, v in (("uint", u), ("int", i), ("int64", big), ("uint64", ubig), ("string", text)):
        assert records.decode(records.native(kind, v), {}, kind) == v
    back = records.decode(records.native("float", x), {}, "float")
    assert back == x or abs(x) < 2**-126  # numbers too small for an exponent are zero


@pytest.mark.parametrize("raw", [False, True])
def test_files(spark, tmp_path, raw):
    parts = canvas_parts()
    for k in range(3):
        (tmp_path / f"{k}.deck").write_bytes(archive.pack(parts, raw))
    rows = archive.read_parts(spark, str(tmp_path))
    assert rows.count() == 3 * (3 if raw else 5)
    nodes = archive.read_nodes(spark, str(tmp_path)).where("path like '%1.deck'").orderBy("ord").collect()
    assert [(n["id"], n["pid"], n["type"], n["text"], n["visible"], n["opacity"]) for n in nodes] == [("0:1", None, "SLIDE", None, False, 0.5), ("4294967295:2", "0:1", "TEXT", "hello\nworld", None, None)]
    if not raw:
        assert {(r["name"], r["width"], r["height"]) for r in archive.images(rows).collect()} == {("images/ab", 640, 480)}
        back = archive.write_archives(rows).collect()
        assert len(back) == 3 and all(sorted(archive.unpack(bytes(r["archive"])), key=str) == sorted(parts, key=str) for r in back)


def test_errors():
    with pytest.raises(ValueError, match="not a canvas"):
        archive.unpack(b"something else")
    with pytest.raises(ValueError, match="cut off"):
        archive.split_canvas(b"fig-kiwi" + struct.pack("<II", 1, 9) + b"abc")


def test_networks(spark):
    loop = [("M", [0.0, 0.0]), ("L", [4.0, 0.0]), ("C", [5.0, 1.0, 5.0, 3.0, 4.0, 4.0]), ("Z", [])]
    closed = [*loop[:-1], ("L", [0.0, 0.0]), ("Z", [])]
    assert paths.decode_network(paths.encode_network([loop])) == closed
    assert paths.decode_network(paths.encode_network([loop, loop]), 2.0, 0.5)[1] == ("L", [8.0, 0.0])
    assert len(paths.decode_network(paths.encode_network([loop, loop]))) == 2 * len(closed)
    assert paths.decode_network(b"\0" * 15) is None and paths.decode_network(None) is None and paths.decode_network(b"\0" * 16) is None
    assert paths.decode_network(paths.encode_network([loop])[:-8])[-1] == ("Z", [])


def test_permissive(spark, tmp_path):
    """A broken file stops a strict read, and is a row of kind error in a permissive one; the others are read."""
    (tmp_path / "good.deck").write_bytes(archive.pack(canvas_parts()))
    (tmp_path / "bad.deck").write_bytes(b"something else")
    parts = archive.read_parts(spark, str(tmp_path), permissive=True)
    assert [r["path"].rsplit("/", 1)[1] for r in parts.where("kind = 'error'").collect()] == ["bad.deck"]
    assert archive.nodes_of(parts.where("kind <> 'error'")).count() == 2
    with pytest.raises(Exception, match="not a canvas"):
        archive.read_parts(spark, str(tmp_path)).count()


def test_typed_and_back(spark, tmp_path):
    """What raw holds comes back through new files: bytes, big numbers, absent fields."""
    (tmp_path / "a.deck").write_bytes(archive.pack(canvas_parts()))
    parts = archive.read_parts(spark, str(tmp_path))
    assert [(r["nodes"], r["slides"], r["chunks"], r["same"]) for r in archive.round_trip(parts).collect()] == [(2, 1, 3, True)]
    again = {r["kind"]: bytes(r["bytes"]) for r in archive.with_nodes(parts, archive.nodes_of(parts)).where("path is not null").collect()}
    assert records.decode(again["message"], SCHEMA, "Message") == {"nodeChanges": NODES}


def test_nodes_in_pieces(spark, monkeypatch):
    """A document's nodes are decoded and encoded in pieces that are dealt out; other fields and the order of nodes stay."""
    monkeypatch.setattr(archive, "PIECE", 10)
    fields = [("blobs", "byte", True, 2), *SCHEMA["Message"][1], ("notes", "Node", True, 300)]
    schema = {**SCHEMA, "Message": ("MESSAGE", fields)}
    many = [{**NODES[k % 2], "guid": {"sessionID": 1, "localID": k}} for k in range(1005)]
    messages = {"a": {"nodeChanges": many, "blobs": b"\1\2\0", "notes": NODES[:1]}, "b": {"nodeChanges": NODES}, "c": {"nodeChanges": []}}
    data = records.encode(messages["a"], schema, "Message")
    spans = records.field_spans(data, schema, "Message")
    pieces = list(records.cuts(data, spans["nodeChanges"], schema, "Node", 10))
    assert [p[:2] for p in pieces] == [(k, min(10, 1005 - k)) for k in range(0, 1005, 10)] and pieces[-1][3] == spans["nodeChanges"][1]
    rows = [(p, kind, ix, archive.CANVAS, "fig-deck", 48, b) for p, m in messages.items() for kind, ix, b in (("schema", 0, records.write_schema(schema)), ("message", 1, records.encode(m, schema, "Message")))]
    parts = spark.createDataFrame(rows, archive.PARTS)
    nodes = archive.nodes_of(parts)
    assert [r["id"] for r in nodes.where("path = 'a'").orderBy("ord").collect()] == [f"1:{k}" for k in range(1005)]
    again = {r["path"]: bytes(r["bytes"]) for r in archive.with_nodes(parts, nodes.where("path <> 'c'")).where("kind = 'message'").collect()}
    assert {p: records.decode(b, schema, "Message") for p, b in again.items()} == messages


def test_font_files(spark, tmp_path):
    from sceneloom.operators import fonts

    (tmp_path / "sub").mkdir()
    for name in ("a.ttf", "sub/b.woff2", "sub/c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["bytes"]) for r in fonts.read_fonts(spark, str(tmp_path)).collect()}
    assert got == {"a.ttf": b"a.ttf", "b.woff2": b"sub/b.woff2"}


def test_messages_in_slices(spark, monkeypatch):
    """A long message is read, given new nodes, packed and read again in slices that do not grow with it."""
    monkeypatch.setattr(archive, "SLICE", 200)
    schema = {**SCHEMA, "Message": ("MESSAGE", [("blobs", "byte", True, 2), *SCHEMA["Message"][1], ("notes", "Node", True, 300)])}
    message = {"nodeChanges": [{**NODES[k % 2], "guid": {"sessionID": 1, "localID": k}} for k in range(300)], "blobs": bytes(1000), "notes": NODES * 50}
    data = records.encode(message, schema, "Message")
    canvas = [("schema", 0, archive.CANVAS, "fig-deck", 48, records.write_schema(schema)), ("message", 1, archive.CANVAS, "fig-deck", 48, data)]
    files = spark.createDataFrame([("a", archive.pack(canvas)), ("b", archive.pack(canvas_parts()))], "path string, content binary")
    parts = archive.parts_of(files).cache()
    rows = parts.where("path = 'a' and kind = 'message'").orderBy("at").collect()
    assert b"".join(bytes(r["bytes"]) for r in rows) == data and len(rows) > 50 and max(len(r["bytes"]) for r in rows) < 300
    assert parts.where("path = 'b' and kind = 'message'").count() == 1
    nodes = archive.nodes_of(parts)
    assert [r["id"] for r in nodes.where("path = 'a'").orderBy("ord").collect()] == [f"1:{k}" for k in range(300)]
    again = archive.with_nodes(parts, nodes)
    assert max(len(r["bytes"]) for r in again.where("path = 'a' and kind = 'message'").collect()) < 300
    packed = {r["path"]: archive.unpack(bytes(r["archive"])) for r in archive.write_archives(again).collect()}
    assert records.decode(packed["a"][1][5], schema, "Message") == message and packed["b"][:3] == canvas_parts()[:3]
    got = {r["path"]: (r["nodes"], r["chunks"], r["same"]) for r in archive.round_trip(parts).collect()}
    assert got == {"a": (300, 2, True), "b": (2, 3, True)}


def test_slices_of_odd_messages():
    """Slices are a message's bytes, whatever it holds; from where the schema does not fit, they say so."""
    schema = {**SCHEMA, "Message": ("MESSAGE", [("blobs", "byte", True, 2), *SCHEMA["Message"][1]])}
    one = records.encode({"nodeChanges": NODES * 9}, schema, "Message")
    for data, odd in ((one, False), (one[:-1] + one, True), (one[:-30], True), (one[:-1] + b"\x09", True), (one + b"rest", False), (b"\0", False), (b"", True)):
        for step in (1, 7, 1000):
            found = list(records.sliced((data[k : k + step] for k in range(0, len(data), step)), schema, "Message", "nodeChanges", 4, 64))
            assert b"".join(x for _, _, x in found) == data and any(n == -1 for _, n, _ in found) == odd
    assert [n for _, n, _ in records.sliced([one], schema, "Message", "nodeChanges", 4, 10**6)] == [0, 4, 4, 4, 4, 2, None]


def test_records_with_the_schema_looked_up_once():
    fields = [*SCHEMA["Node"][1], ("kids", "Node", True, 200), ("numbers", "int", True, 11), ("bytes", "byte", False, 12), ("ubig", "uint64", True, 13), ("odd", "NodeType", True, 14)]
    schema = {**SCHEMA, "Node": ("MESSAGE", fields)}
    node = {**NODES[1], "kids": NODES, "numbers": [-70, 0, 2**31 - 1], "bytes": 255, "ubig": [2**64 - 1], "odd": ["TEXT"], "opacity": -2.5}
    data = records.encode(node, schema, "Node")
    assert records.writer(schema, "Node")(node) == records.writer(schema, "Node")({**node, "hash": "00ff"}) == data
    assert records.reader(schema, "Node")(b"x" + data, 1) == (records.decode(data, schema, "Node"), len(data) + 1)
    assert records.reader(schema, "NodeType")(b"\x63", 0) == (99, 1)
