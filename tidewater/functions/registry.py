"""The functions of the dialect: name, number of arguments, lowering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArityError, TypeMismatch, UnknownFunction
from .typed import INTEGRAL, Typed, common, numeric
from .typed import _decimal as bounded

_DOUBLE = T.DoubleType()


def _whole(function):
    """CEIL and FLOOR keep the type of their argument."""

    def build(x: Typed) -> Typed:
        return x if isinstance(x.type, INTEGRAL) else Typed(function(x.column).cast(x.type), x.type)

    return build


def _double(function: Callable[..., Column]):
    return lambda *args: Typed(function(*(a.column.cast("double") for a in args)), _DOUBLE)


def _ln(x: Column) -> Column:
    """IEEE logarithm: -inf at 0 and NaN below, where Spark gives NULL."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


#: name: (arguments, builder); all arguments are numbers.
_SCALAR: dict[str, tuple[int, Callable[..., Typed]]] = {
    "ABS": (1, lambda x: Typed(F.abs(x.column), x.type)),
    "CEIL": (1, _whole(F.ceil)),
    "FLOOR": (1, _whole(F.floor)),
    "EXP": (1, _double(F.exp)),
    "LN": (1, _double(_ln)),
    "SQRT": (1, _double(F.sqrt)),
    "POWER": (2, _double(F.pow)),
    "SIN": (1, _double(F.sin)),
    "COS": (1, _double(F.cos)),
    "TAN": (1, _double(F.tan)),
    "ASIN": (1, _double(F.asin)),
    "ACOS": (1, _double(F.acos)),
    "ATAN": (1, _double(F.atan)),
    "ATAN2": (2, _double(F.atan2)),
    "MOD": (2, None),  # the operator %
    "SGN": (1, _double(F.signum)),
}

#: name: Spark's aggregate.
_AGGREGATE = {"COUNT": "count", "SUM": "sum", "AVG": "avg", "AVERAGE": "avg", "MEAN": "avg", "MIN": "min", "MAX": "max", "STDDEV": "stddev_samp", "VARIANCE": "var_samp", "STDDEVP": "stddev_pop", "VARIANCEP": "var_pop"}


def is_aggregate(name: str) -> bool:
    return name in _AGGREGATE


def scalar(name: str, args: list[Typed]) -> Typed:
    if name == "COALESCE":
        if not args:
            raise ArityError("COALESCE needs an argument")
        return common(args, name)
    if name not in _SCALAR:
        raise UnknownFunction(name)
    wanted, build = _SCALAR[name]
    if len(args) != wanted:
        raise ArityError(f"{name} takes {wanted} argument{'s' * (wanted > 1)}, not {len(args)}")
    args = [numeric(a, name) for a in args]
    if name == "MOD":
        from .typed import arithmetic

        return arithmetic("%", *args)
    return build(*args)


def result(name: str, kind: T.DataType | None) -> T.DataType:
    """The type of an aggregate over a column of type `kind`."""
    if name == "COUNT":
        return T.LongType()
    if name in ("MIN", "MAX"):
        return kind
    if isinstance(kind, T.DecimalType) and _AGGREGATE[name] in ("sum", "avg"):
        more = 10 if name == "SUM" else 4
        return bounded(kind.precision + more, kind.scale + (0 if name == "SUM" else 4))
    return T.LongType() if name == "SUM" and isinstance(kind, INTEGRAL) else _DOUBLE


def aggregate(name: str, distinct: bool, column: Column | str | None, kind: T.DataType | None) -> Column:
    """The aggregate over a column, by name where `needs_name`, or over rows if column is None.

    DISTINCT changes nothing for MIN and MAX.  SUM keeps Spark's wider result type.
    """
    function = _AGGREGATE[name]
    if column is None:
        if name != "COUNT" or distinct:
            raise TypeMismatch(f"{name} takes no '*'")
        return F.count(F.lit(1))
    if name not in ("COUNT", "MIN", "MAX") and not isinstance(kind, (T.NumericType, T.NullType)):
        raise TypeMismatch(f"{name} needs a number, not {kind.simpleString()}")
    if needs_name(name, distinct):
        return F.expr(f"{function}(DISTINCT `{column}`)")
    return getattr(F, function)(column)


def needs_name(name: str, distinct: bool) -> bool:
    return distinct and name not in ("MIN", "MAX")
