"""Scalar functions on text and vectors, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at both ends, Unicode's too."""
    return F.btrim(x, F.lit(WHITE))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def preview(x: Column, n: int = 200) -> Column:
    """The first n characters, with `...` if there are more."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def informative_lines(x: Column, over: int = 20, first: int = 4) -> Column:
    """The first stripped lines of over `over` characters."""
    lines = F.transform(F.split(x, "\n", -1), strip)
    return F.slice(F.filter(lines, lambda s: F.length(s) > over), 1, first)


def ordered_join(order: Column, text: Column, between: str) -> Column:
    """Aggregate: the texts in the given order, joined. Groups are bounded by what a prompt holds (k hits)."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r.t), between)


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """v over its norm; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Null for a null, empty, zero or wrongly sized vector, never NaN."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.try_divide(dot(a, b), norm(a) * norm(b)))
