"""Columns with their types, and the rules of arithmetic and comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch

#: Numeric types from widest to narrowest; the first that an operand has is the result's.
_ORDER = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
TEXT = (T.StringType, T.VarcharType, T.CharType)


@dataclass(frozen=True)
class Typed:
    column: Column
    type: T.DataType

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def null(self) -> bool:
        return isinstance(self.type, T.NullType)


def numeric(x: Typed, what: str) -> Typed:
    if x.null:
        return Typed(x.column.cast("double"), T.DoubleType())
    if not x.numeric:
        raise TypeMismatch(f"{what} needs a number, not {x.type.simpleString()}")
    return x


def boolean(x: Typed, what: str) -> Column:
    if x.null:
        return x.column.cast("boolean")
    if not isinstance(x.type, T.BooleanType):
        raise TypeMismatch(f"{what} needs a condition, not {x.type.simpleString()}")
    return x.column


#: Digits that whole numbers may have.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def decimal(t: T.DataType) -> T.DecimalType:
    """The decimal type that holds all values of t."""
    return t if isinstance(t, T.DecimalType) else T.DecimalType(_DIGITS[type(t)], 0)


def _decimal(precision: int, scale: int) -> T.DecimalType:
    """Beyond 38 digits the scale gives way, down to 6."""
    if precision > 38:
        precision, scale = 38, max(38 - (precision - scale), min(scale, 6))
    return T.DecimalType(precision, scale)


def wider(a: T.DecimalType, b: T.DecimalType) -> T.DecimalType:
    scale = max(a.scale, b.scale)
    return _decimal(max(a.precision - a.scale, b.precision - b.scale) + scale, scale)


def computed(op: str, a: T.DecimalType, b: T.DecimalType) -> T.DecimalType:
    """The type of a result, as SQL has it."""
    whole, scale = max(a.precision - a.scale, b.precision - b.scale), max(a.scale, b.scale)
    if op in "+-":
        return _decimal(whole + scale + 1, scale)
    if op == "*":
        return _decimal(a.precision + b.precision + 1, a.scale + b.scale)
    if op == "/":
        scale = max(6, a.scale + b.precision + 1)
        return _decimal(a.precision - a.scale + b.scale + scale, scale)
    return _decimal(min(a.precision - a.scale, b.precision - b.scale) + scale, scale)


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        if isinstance(a, (T.DoubleType, T.FloatType)) or isinstance(b, (T.DoubleType, T.FloatType)):
            return T.DoubleType()
        return wider(decimal(a), decimal(b))
    wide = next(t for t in _ORDER if isinstance(a, t) or isinstance(b, t))
    # literals are INTEGER at least, and so is what is computed
    return T.IntegerType() if wide in (T.ShortType, T.ByteType) else wide()


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN where Spark would raise."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    # only as text has a zero a sign
    zero = F.when(a.isNull(), F.lit(None)).when(F.isnan(a) | (a == 0), nan).when((a > 0) == ~b.cast("string").startswith("-"), inf).otherwise(-inf)
    return F.when(b.isNull(), F.lit(None)).when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    a, b = numeric(a, f"'{op}'"), numeric(b, f"'{op}'")
    to = promoted(a.type, b.type)
    exact = isinstance(to, T.DecimalType)
    x, y = (v.column if v.type == (t := decimal(v.type) if exact else to) else v.column.cast(t) for v in (a, b))
    if exact:
        to = computed(op, decimal(a.type), decimal(b.type))
    match op:
        case "+":
            out = x + y
        case "-":
            out = x - y
        case "*":
            out = x * y
        case "/" if isinstance(to, INTEGRAL):
            out = F.call_function("div", x, y).cast(to)
        case "/":
            out = x / y if exact else _divide(x, y).cast(to)
        case "%" if isinstance(to, INTEGRAL) or exact:
            out = x % y
        case "%":
            out = F.when(y == 0, F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(x % F.when(y != 0, y)).cast(to)
    return Typed(out, to)


def negated(a: Typed) -> Typed:
    return arithmetic("-", Typed(F.lit(0), T.IntegerType()), a) if isinstance(a.type, INTEGRAL) else Typed(-numeric(a, "'-'").column, numeric(a, "'-'").type)


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, TEXT):
        return "text"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return t.simpleString()


def compare(op: str, a: Typed, b: Typed) -> Typed:
    if not (a.null or b.null) and _kind(a.type) != _kind(b.type):
        raise TypeMismatch(f"can't compare {a.type.simpleString()} with {b.type.simpleString()}")
    x, y = a.column, b.column
    out = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Typed(out, T.BooleanType())


def comparable(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type to which Spark brings both sides of a comparison; None where that isn't plain."""
    if a == b:
        return a if _kind(a) in ("number", "text", "time") else None
    if _kind(a) != "number" or _kind(b) != "number":
        return None
    to = promoted(a, b)
    return None if isinstance(to, (T.DecimalType, T.FloatType)) or isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType) else to


def alternatives(values: list[Typed], what: str) -> tuple[list[Column], T.DataType]:
    """Columns of one type."""
    known = [v for v in values if not v.null]
    if not known:
        return [v.column for v in values], values[0].type
    to = known[0].type
    for v in known[1:]:
        if v.numeric and isinstance(to, T.NumericType):
            to = to if to == v.type else promoted(to, v.type)
        elif _kind(v.type) != _kind(to):
            raise TypeMismatch(f"{what}: {to.simpleString()} and {v.type.simpleString()} don't mix")
    return [v.column if v.type == to else v.column.cast(to) for v in values], to


def common(values: list[Typed], what: str) -> Typed:
    """The first value that isn't NULL."""
    columns, to = alternatives(values, what)
    return Typed(F.coalesce(*columns), to)
