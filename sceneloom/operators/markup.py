"""What drawings share: paints as colours, and text put together from pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneloom.functions.scalars import colour_form, constant, each

PAINT = "struct<type:string,visible:boolean,opacity:double,r:double,g:double,b:double,a:double>"


def tag(form: str, *values: Column) -> Column:
    """form with each {} replaced by a value; null if a value is null."""
    pieces = form.split("{}")
    out = [constant(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [value, constant(piece)]
    return F.concat(*out)


def lines(*parts: Column) -> Column:
    """The non-empty parts, one to a line."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


_COLOUR = colour_form("(coalesce(v.a, 1D) * coalesce(v.opacity, 1D))")


def paint_colour(p: Column) -> Column:
    """The colour of a paint, its opacity in the alpha."""
    return each(F.array(p), _COLOUR)[0]


def solid(paints: Column) -> Column:
    """Colour of the first visible solid paint, or null."""
    seen = F.call_function("filter", paints, constant("v -> v.type = 'SOLID' AND coalesce(v.visible, true)", F.expr))
    return F.call_function("get", each(seen, _COLOUR), constant("0", F.expr))
