"""Facts of files that pictures come in: sizes from headers, and vector graphics as shapes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneloom.functions.ranking import numbered, numbered_within
from sceneloom.functions.scalars import guid_id, position_char
from sceneloom.operators.shapes import SESSION, SHAPE, paint, placed, resolve_colours
from sceneloom.operators.template import next_local

from . import paths

#: How files begin, and the markers of frames that carry a JPEG's size.
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def picture_size(data: bytes | None) -> tuple[int, int]:
    """(width, height) by the header of a PNG or JPEG; (0, 0) for anything else."""
    if data and data[:8] == PNG and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    at = 2 if data and data[:2] == JPEG else len(data or b"")
    while at + 9 <= len(data or b"") and data[at] == 0xFF:
        kind, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        if kind in FRAMES:
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + size
    return 0, 0


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def sizes(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([picture_size(d) for d in data], columns=["width", "height"], dtype="int64")


def view_box(svg: Column) -> Column:
    """(width, height) of a graphic's view box; a graphic without one is an error."""
    box = F.split(F.regexp_extract(svg, 'viewBox="([^"]+)"', 1), r"\s+")
    lost = F.raise_error("a graphic needs a viewBox").cast("double")
    part = lambda k: F.coalesce(F.get(box, F.lit(k)).try_cast("double"), lost)
    return F.struct(part(2).alias("width"), part(3).alias("height"))


def path_data(svg: Column) -> Column:
    """The data of all paths of a graphic, in order; a graphic without any is an error."""
    found = F.regexp_extract_all(svg, F.lit(r'<path\b[^>]*\bd="([^"]+)"'), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.raise_error("a graphic needs a path").cast("array<string>"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _fills(data: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series([[paths.encode_path(paths.parse_svg_path(d), s) for d in ds] for ds, s in zip(data, scale)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _network(data: pd.Series) -> pd.Series:
    return pd.Series([paths.encode_network([paths.parse_svg_path(d) for d in ds]) for ds in data], dtype=object)


def add_graphics(nodes: DataFrame, asks: DataFrame, variables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, byte strings) for graphics to be placed: asks have k, parent, x, y, width, svg, colour, name (may be null).

    A graphic is a frame with one vector, as high as its view box asks for; each of its paths is a fill region, in the
    size of the node, and all are one network, in the size of the graphic. Byte strings: id (of the vector), ix from 0, kind
    (fill or network), bytes.
    """
    rows = resolve_colours(asks.withColumn("colour", F.coalesce("colour", F.lit("Black"))), variables)
    rows = rows.withColumns({"_box": view_box(F.col("svg")), "_data": path_data(F.col("svg"))})
    scale = F.col("width") / F.col("_box.width")
    rows = rows.withColumns({"_scale": scale, "_height": F.col("width") * (F.col("_box.height") / F.col("_box.width")), "_called": F.coalesce("name", F.lit("SVG"))})
    rows = numbered(rows, ["k"], "_n", 0)
    children = nodes.groupBy(F.col("pid").alias("parent")).agg(F.count(F.lit(1)).alias("_children"))
    base, last = next_local(nodes), nodes.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    frame_id, vector_id = (guid_id(F.lit(SESSION), F.col("_n") * 2 + base + k) for k in (0, 1))
    pieces = rows.select(vector_id.alias("id"), _fills("_data", "_scale").alias("fills"), _network("_data").alias("network"))
    # one parent may have all graphics: they are numbered below it by ranges
    children = children.join(rows.select("parent").distinct(), "parent", "left_semi")
    rows = numbered_within(rows.drop("svg", "_data"), "parent", ["k"], "_below").join(children, "parent", "left").withColumn("_place", F.coalesce("_children", F.lit(0)) + F.col("_below"))
    common = {"phase": F.lit("CREATED"), "visible": F.lit(True), "opacity": F.lit(1.0), "width": F.col("width"), "height": F.col("_height"), "stroke_align": F.lit("INSIDE")}
    frame = common | {"id": frame_id, "pid": F.col("parent"), "position": position_char(F.col("_place")), "type": F.lit("FRAME"), "name": F.col("_called"), "transform": placed(F.col("x"), F.col("y")), "stroke_weight": F.lit(1.0), "mask_disabled": F.lit(True)}
    vector = common | {"id": vector_id, "pid": frame_id, "position": F.lit("!"), "type": F.lit("VECTOR"), "name": F.concat("_called", F.lit("_vector")), "transform": placed(F.lit(0.0), F.lit(0.0)), "stroke_weight": F.lit(0.0), "fill_paints": F.array(paint(F.col("r"), F.col("g"), F.col("b")))}
    made = lambda of, k: rows.select("k", (F.col("_n") * 2 + last + 1 + k).alias("ord"), *(of.get(c, F.lit(None)).cast(t).alias(c) for c, t in SHAPE.items()))
    fills = pieces.select("id", F.posexplode("fills").alias("ix", "bytes")).select("id", "ix", F.lit("fill").alias("kind"), "bytes")
    network = pieces.select("id", F.size("fills").alias("ix"), F.lit("network").alias("kind"), F.col("network").alias("bytes"))
    # what reads the bytes runs in tasks of its own, so that its Python workers do not stand beside those that made them
    return made(frame, 0).unionByName(made(vector, 1)), fills.unionByName(network).repartition("id")
