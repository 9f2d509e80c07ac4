"""Scalar functions of the cube language as Columns.

No data is NULL.  NaN and infinities become NULL when data is read (`finite`); every function here gives NULL where its
result would be none, so neither ANSI errors nor Spark's order of NaN come into play.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """`c` as a double, NULL where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """The remainder that has the sign of the divisor."""
    return a - b * F.floor(divide(a, b)).cast("double")


def power(a: Column, b: Column) -> Column:
    return finite(F.pow(a, b))


def normalized_difference(a: Column, b: Column) -> Column:
    return divide(a - b, a + b)


def _known(*cs: Column) -> Column:
    out = cs[0].isNotNull()
    for c in cs[1:]:
        out = out & c.isNotNull()
    return out


def all_known(value: Column, *cs: Column) -> Column:
    """`value` where all of `cs` are known: built-ins that skip NULL are guarded by it."""
    return F.when(_known(*cs), value)


def minimum(*cs: Column) -> Column:
    return cs[0] if len(cs) == 1 else all_known(F.least(*cs), *cs)


def maximum(*cs: Column) -> Column:
    return cs[0] if len(cs) == 1 else all_known(F.greatest(*cs), *cs)


def total(*cs: Column) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out + c
    return out


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return all_known(F.least(F.greatest(x, lo), hi), x, lo, hi)


def where(c: Column, a: Column, b: Column) -> Column:
    """`a` where the condition holds, `b` where it doesn't, none where it is unknown."""
    return F.when(c.isNull(), None).when(c != 0, a).otherwise(b)


def truth(c: Column) -> Column:
    """A three-valued truth as 1, 0 or NULL."""
    return c.cast("double")


def both(a: Column, b: Column) -> Column:
    return truth((a != 0) & (b != 0))


def either(a: Column, b: Column) -> Column:
    return truth((a != 0) | (b != 0))


def negated(a: Column) -> Column:
    return truth(~(a != 0))


def one_of(x: Column, *values: Column) -> Column:
    return truth(x.isin(*values))


def bits(x: Column, start: int, count: int) -> Column:
    return F.shiftright(x.cast("long"), start).bitwiseAND((1 << count) - 1).cast("double")


#: Quality codes that count as clear.  Fixed values: cloud, shadow and snow bits of the products named.
USABLE = {
    "fmask": lambda q: q.isin(0, 1),
    "landsat_c2": lambda q: q.bitwiseAND(0x3B) == 0,  # fill, dilated cloud, cloud, shadow, snow; not cirrus
    "scl": lambda q: q.between(4, 6),
    "nonzero": lambda q: q != 0,
    "zero": lambda q: q == 0,
    "hls": lambda q: (q != 255) & (q.bitwiseAND(0x1E) == 0),
}


def usable(code: Column, rule: str) -> Column:
    if rule not in USABLE:
        raise ValueError(f"no quality rule {rule!r}; there are {', '.join(sorted(USABLE))}")
    return USABLE[rule](code.cast("long"))


def qa(x: Column, code: Column, rule: str) -> Column:
    """`x` where its quality code counts as clear."""
    return F.when(usable(code, rule), x)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


#: name: (least and greatest number of arguments, function)
SCALARS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "sqrt": (1, 1, lambda x: finite(F.sqrt(x))),
    "abs": (1, 1, F.abs),
    "exp": (1, 1, lambda x: finite(F.exp(x))),
    "log": (1, 1, F.ln),
    "ln": (1, 1, F.ln),
    "log10": (1, 1, F.log10),
    "log2": (1, 1, F.log2),
    "round": (1, 1, F.rint),
    "floor": (1, 1, lambda x: F.floor(x).cast("double")),
    "ceil": (1, 1, lambda x: F.ceil(x).cast("double")),
    "trunc": (1, 1, truncate),
    "sign": (1, 1, F.signum),
    "sin": (1, 1, F.sin),
    "cos": (1, 1, F.cos),
    "tan": (1, 1, F.tan),
    "asin": (1, 1, lambda x: finite(F.asin(x))),
    "acos": (1, 1, lambda x: finite(F.acos(x))),
    "atan": (1, 1, F.atan),
    "sinh": (1, 1, lambda x: finite(F.sinh(x))),
    "cosh": (1, 1, lambda x: finite(F.cosh(x))),
    "tanh": (1, 1, F.tanh),
    "atan2": (2, 2, F.atan2),
    "hypot": (2, 2, F.hypot),
    "mod": (2, 2, modulo),
    "pow": (2, 2, power),
    "nd": (2, 2, normalized_difference),
    "where": (3, 3, where),
    "if": (3, 3, where),
    "clamp": (3, 3, clamp),
    "isnan": (1, 1, lambda x: truth(x.isNull())),
    "isvalid": (1, 1, lambda x: truth(x.isNotNull())),
    "coalesce": (1, 99, F.coalesce),
    "in": (2, 99, one_of),
}

#: Functions that are n-ary over values and reductions over one series.
N_ARY: dict[str, Callable[..., Column]] = {"min": minimum, "max": maximum, "sum": total, "mean": lambda *cs: total(*cs) / float(len(cs))}

CONSTANTS = {"pi": math.pi, "e": math.e, "nan": None, "inf": None}
