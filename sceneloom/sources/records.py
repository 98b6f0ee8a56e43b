"""Schema-driven binary records: a public compact format in which a file carries its own schema.

Numbers are little groups of seven bits; a float is its 32 bits turned by nine places, or one zero byte.
A struct is its fields in order, a message its fields by number up to a zero, an enum a number.
"""

from __future__ import annotations

import struct

#: Built-in types by -1 - number, and kinds of definitions by number.
NATIVE = ("bool", "byte", "int", "uint", "float", "string", "int64", "uint64")
KINDS = ("ENUM", "STRUCT", "MESSAGE")


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def uint(self, groups: int = 5) -> int:
        """Seven bits at a time; in 64-bit numbers the ninth byte has all eight."""
        value = 0
        for k in range(groups):
            b = self.byte()
            if groups == 9 and k == 8:
                return value | b << 56
            value |= (b & 127) << 7 * k
            if b < 128:
                break
        return value

    def int(self, groups: int = 5) -> int:
        v = self.uint(groups)
        return -(v >> 1) - 1 if v & 1 else v >> 1

    def float(self) -> float:
        if self.data[self.at] == 0:
            self.at += 1
            return 0.0
        (bits,) = struct.unpack_from("<I", self.data, self.at)
        self.at += 4
        return struct.unpack("<f", struct.pack("<I", (bits << 23 | bits >> 9) & 0xFFFFFFFF))[0]

    def string(self) -> str:
        end = self.data.index(0, self.at)
        text, self.at = self.data[self.at : end].decode(), end + 1
        return text

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def native(self, kind: str):
        if kind == "bool":
            return self.byte() != 0
        if kind in ("int64", "uint64"):
            return self.int(9) if kind == "int64" else self.uint(9)
        return getattr(self, kind)()


def uint(value: int, groups: int = 5) -> bytes:
    out = bytearray()
    while value > 127 and len(out) < groups - 1:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def native(kind: str, v) -> bytes:
    if kind in ("bool", "byte"):
        return bytes([int(v)])
    if kind in ("int", "int64"):
        return uint(v << 1 if v >= 0 else (-v - 1) << 1 | 1, 9 if kind == "int64" else 5)
    if kind in ("uint", "uint64"):
        return uint(v, 9 if kind == "uint64" else 5)
    if kind == "string":
        return v.encode() + b"\0"
    (bits,) = struct.unpack("<I", struct.pack("<f", v))
    bits = bits >> 23 | bits << 9 & 0xFFFFFFFF
    return struct.pack("<I", bits) if bits & 255 else b"\0"


def read_schema(data: bytes) -> dict[str, tuple[str, list[tuple[str, str | None, bool, int]]]]:
    """Definitions by name: (kind, fields), each field (name, type, repeated, number)."""
    r = Reader(data)
    raw = [(r.string(), KINDS[r.byte()], [(r.string(), r.int(), r.byte() == 1, r.uint()) for _ in range(r.uint())]) for _ in range(r.uint())]
    names = [name for name, _, _ in raw]
    of = lambda kind, t: None if kind == "ENUM" else NATIVE[-1 - t] if t < 0 else names[t]
    return {name: (kind, [(f, of(kind, t), many, n) for f, t, many, n in fields]) for name, kind, fields in raw}


def write_schema(schema: dict) -> bytes:
    names, out = list(schema), [uint(len(schema))]
    for name, (kind, fields) in schema.items():
        out += [native("string", name), bytes([KINDS.index(kind)]), uint(len(fields))]
        for f, t, many, n in fields:
            number = 0 if t is None else -1 - NATIVE.index(t) if t in NATIVE else names.index(t)
            out += [native("string", f), native("int", number), bytes([many]), uint(n)]
    return b"".join(out)


def decode(data: bytes, schema: dict, kind: str):
    """The record of a type at the start of data. Absent fields are absent; an unknown field number is an error."""
    return read(Reader(data), schema, kind)


def read(r: Reader, schema: dict, kind: str):
    """The record of a type at the reader's place."""
    if kind in NATIVE:
        return r.native(kind)
    form, fields = schema[kind]
    if form == "ENUM":
        n = r.uint()
        return next((f for f, _, _, k in fields if k == n), n)
    if form == "STRUCT":
        return {f: _field(r, schema, t, many) for f, t, many, _ in fields}
    out, by_number = {}, {n: (f, t, many) for f, t, many, n in fields}
    while n := r.uint():
        f, t, many = by_number[n]
        out[f] = _field(r, schema, t, many)
    return out


def _field(r: Reader, schema: dict, kind: str, many: bool):
    if not many:
        return read(r, schema, kind)
    return r.raw(r.uint()) if kind == "byte" else [read(r, schema, kind) for _ in range(r.uint())]


def reader(schema: dict, kind: str):
    """A function (data, at) -> (record, end): what read gives, with the schema looked up once."""
    made = {}

    def wide(name: str):
        def get(data, at):
            r = Reader(data)
            r.at = at
            return r.native(name), r.at

        return get

    def uint5(data, at):
        b = data[at]
        return (b, at + 1) if b < 128 else _number(data, at)

    def int5(data, at):
        v, at = uint5(data, at)
        return (-(v >> 1) - 1 if v & 1 else v >> 1), at

    def text(data, at):
        end = data.index(0, at)
        return data[at:end].decode(), end + 1

    natives = {"bool": lambda data, at: (data[at] != 0, at + 1), "byte": lambda data, at: (data[at], at + 1), "uint": uint5, "int": int5, "string": text, **{k: wide(k) for k in ("float", "int64", "uint64")}}

    def field(t: str, many: bool):
        if not many:
            return of(t)
        if t == "byte":

            def raw(data, at):
                n, at = uint5(data, at)
                return data[at : at + n], at + n

            return raw
        one = of(t)

        def several(data, at):
            n, at = uint5(data, at)
            out = []
            for _ in range(n):
                v, at = one(data, at)
                out.append(v)
            return out, at

        return several

    def of(t: str):
        if t in natives:
            return natives[t]
        if t not in made:
            form, fields = schema[t]
            made[t] = lambda data, at: made[t, "whole"](data, at)  # types that hold themselves
            names = {k: f for f, _, _, k in reversed(fields)} if form == "ENUM" else None
            steps = {n: (f, field(ft, many)) for f, ft, many, n in fields} if form == "MESSAGE" else [(f, field(ft, many)) for f, ft, many, _ in fields] if form == "STRUCT" else None

            def enum(data, at):
                n, at = uint5(data, at)
                return names.get(n, n), at

            def message(data, at):
                out = {}
                while True:
                    n, at = uint5(data, at)
                    if n == 0:
                        return out, at
                    f, step = steps[n]
                    out[f], at = step(data, at)

            def struct_(data, at):
                out = {}
                for f, step in steps:
                    out[f], at = step(data, at)
                return out, at

            made[t, "whole"] = enum if form == "ENUM" else message if form == "MESSAGE" else struct_
        return made[t, "whole"] if (t, "whole") in made else made[t]

    return of(kind)


def writer(schema: dict, kind: str):
    """A function (record) -> bytes: what encode gives, with the schema looked up once. Byte strings may be given as hexadecimal digits."""
    made, small = {}, [bytes([k]) for k in range(128)]
    number = lambda v: small[v] if 0 <= v < 128 else uint(v)

    def field(t: str, many: bool):
        if not many:
            return of(t)
        if t == "byte":

            def raw(v, out):
                v = bytes.fromhex(v) if isinstance(v, str) else bytes(v)
                out.append(number(len(v)))
                out.append(v)

            return raw
        one = of(t)

        def several(v, out):
            out.append(number(len(v)))
            for x in v:
                one(x, out)

        return several

    def of(t: str):
        if t == "string":
            return lambda v, out: out.append(v.encode() + b"\0")
        if t == "uint":
            return lambda v, out: out.append(number(v))
        if t in NATIVE:
            return lambda v, out: out.append(native(t, v))
        if t not in made:
            form, fields = schema[t]
            made[t] = lambda v, out: made[t, "whole"](v, out)  # types that hold themselves
            if form == "ENUM":
                codes = {f: uint(k) for f, _, _, k in reversed(fields)}
                made[t, "whole"] = lambda v, out: out.append(codes[v])
                return made[t, "whole"]
            steps = [(f, uint(n), field(ft, many)) for f, ft, many, n in fields]

            def message(v, out):
                for f, head, step in steps:
                    x = v.get(f)
                    if x is not None:
                        out.append(head)
                        step(x, out)
                out.append(b"\0")

            def struct_(v, out):
                for f, _, step in steps:
                    step(v[f], out)

            made[t, "whole"] = message if form == "MESSAGE" else struct_
        return made[t, "whole"] if (t, "whole") in made else made[t]

    one = of(kind)

    def write(v) -> bytes:
        out = []
        one(v, out)
        return b"".join(out)

    return write


def skipper(schema: dict, kind: str):
    """A function (data, at) -> end of the record of a type that begins at a place, without reading its values. An unknown field number is an error."""
    made = {}

    def number(groups: int):
        def skip(data, at):
            last = at + groups - 1
            while at < last and data[at] > 127:
                at += 1
            return at + 1

        return skip

    uint5 = number(5)
    natives = {"bool": lambda data, at: at + 1, "float": lambda data, at: at + 1 if data[at] == 0 else at + 4, "string": lambda data, at: data.index(0, at) + 1, "int64": number(9), "uint64": number(9), "int": uint5, "uint": uint5}
    natives["byte"] = natives["bool"]

    def field(t: str, many: bool):
        one = None if many and t == "byte" else of(t)
        if not many:
            return one

        def skip(data, at):
            n, at = _number(data, at)
            if one is None:
                return at + n
            for _ in range(n):
                at = one(data, at)
            return at

        return skip

    def of(t: str):
        if t in natives:
            return natives[t]
        if t not in made:
            form, fields = schema[t]
            made[t] = lambda data, at: made[t, "whole"](data, at)  # types that hold themselves
            steps = {n: field(ft, many) for _, ft, many, n in fields} if form == "MESSAGE" else [field(ft, many) for _, ft, many, _ in fields] if form == "STRUCT" else None

            def message(data, at):
                while True:
                    n = data[at]
                    if n == 0:
                        return at + 1
                    if n > 127:
                        n, at = _number(data, at)
                    else:
                        at += 1
                    at = steps[n](data, at)

            def struct_(data, at):
                for step in steps:
                    at = step(data, at)
                return at

            made[t, "whole"] = uint5 if form == "ENUM" else message if form == "MESSAGE" else struct_
        return made[t, "whole"] if (t, "whole") in made else made[t]

    return of(kind)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """(uint, place behind it)."""
    value = 0
    for k in range(5):
        b = data[at + k]
        value |= (b & 127) << 7 * k
        if b < 128:
            break
    return value, at + k + 1


def field_spans(data: bytes, schema: dict, kind: str) -> dict[str, tuple[int, int]]:
    """(start, end) of the value of each field of the message at the start of data; where one repeats, its last."""
    one = {n: (f, t, many) for f, t, many, n in schema[kind][1]}
    skips, out, at = {}, {}, 0
    while True:
        n, at = _number(data, at)
        if n == 0:
            return out
        f, t, many = one[n]
        start = at
        if many:
            count, at = _number(data, at)
            if t == "byte":
                at += count
            else:
                skip = skips.setdefault(t, skipper(schema, t))
                for _ in range(count):
                    at = skip(data, at)
        else:
            at = skips.setdefault(t, skipper(schema, t))(data, at)
        out[f] = (start, at)


def cuts(data: bytes, span: tuple[int, int], schema: dict, kind: str, most: int):
    """Pieces of a repeated field of records: (number of the first one, how many, start, end), each of at most so many records."""
    count, at = _number(data, span[0])
    skip = skipper(schema, kind)
    for first in range(0, count, most):
        start, n = at, min(most, count - first)
        for _ in range(n):
            at = skip(data, at)
        yield first, n, start, at


class _Stream:
    """Bytes that come in chunks; what stands before `keep` is let go when more is read."""

    def __init__(self, chunks) -> None:
        self.data, self.at, self.keep, self.chunks = b"", 0, 0, iter(chunks)

    def more(self) -> bool:
        """Read at least as much again as is held."""
        held = [self.data[self.keep :]]
        want, got = max(1, len(held[0])), 0
        while got < want and (chunk := next(self.chunks, None)) is not None:
            held.append(chunk)
            got += len(chunk)
        self.data, self.at, self.keep = b"".join(held), self.at - self.keep, 0
        return got > 0

    def step(self, skip) -> None:
        """Go to where skip(data, at) ends, reading on while that is not at hand."""
        while True:
            try:
                end = skip(self.data, self.at)
                if end <= len(self.data):
                    self.at = end
                    return
            except (IndexError, ValueError):
                pass
            if not self.more():
                raise ValueError("a message is cut off")

    def number(self) -> int:
        found = []

        def skip(data, at):
            value, end = _number(data, at)
            found[:] = [value]
            return end

        self.step(skip)
        return found[0]

    def passed(self) -> bytes:
        out, self.keep = self.data[self.keep : self.at], self.at
        return out


def sliced(chunks, schema: dict, kind: str, field: str, most: int, size: int):
    """A message that comes in chunks, in slices: (first, n, bytes). Together they are its bytes, and no more than a slice and a record are held.

    Slices of the records of one repeated field hold n whole records (at most so many, about so many bytes), the first of them number `first`; (0, 0) is that
    field's head. Where n is None stand the other fields: together, a message without that field. From where the schema does not fit, or
    the field comes again, n is -1.
    """
    s = _Stream(chunks)
    try:
        one = {n: (f, t, many) for f, t, many, n in schema[kind][1]}
        seen = False
        while True:
            before = s.passed()
            if before:
                yield None, None, before
            number = s.number()
            if number == 0:
                yield None, None, s.passed()
                while s.more():
                    s.at = len(s.data)
                    yield None, None, s.passed()
                if len(s.data) > s.keep:
                    yield None, None, s.data[s.keep :]
                return
            f, t, many = one[number]
            if f == field and seen:
                raise ValueError(f"{field} comes again")
            count = s.number() if many else 1
            if f == field:
                seen = True
                yield 0, 0, s.passed()
            if many and t == "byte":
                while count:
                    if s.at == len(s.data) and not s.more():
                        raise ValueError("a message is cut off")
                    n = min(count, len(s.data) - s.at, size)
                    s.at, count = s.at + n, count - n
                    yield None, None, s.passed()
                continue
            skip, first = skipper(schema, t), 0
            for k in range(count):
                s.step(skip)
                if s.at - s.keep >= size or (f == field and (k + 1 - first == most or k + 1 == count)):
                    yield *((first, k + 1 - first) if f == field else (None, None)), s.passed()
                    first = k + 1
    except (KeyError, IndexError, ValueError, TypeError):
        yield -1, -1, s.data[s.keep :]
        for chunk in s.chunks:
            yield -1, -1, chunk


def encode(value, schema: dict, kind: str) -> bytes:
    """Bytes of a record; fields that are None or absent are left out of messages."""
    if kind in NATIVE:
        return native(kind, value)
    form, fields = schema[kind]
    if form == "ENUM":
        return uint(next(k for f, _, _, k in fields if f == value))
    item = lambda v, t, many: (uint(len(v)) + (bytes(v) if t == "byte" else b"".join(encode(x, schema, t) for x in v))) if many else encode(v, schema, t)
    if form == "STRUCT":
        return b"".join(item(value[f], t, many) for f, t, many, _ in fields)
    return b"".join(uint(n) + item(value[f], t, many) for f, t, many, n in fields if value.get(f) is not None) + b"\0"
