"""Syntax tree.  Nodes are values: equal calls are the same aggregate."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: object
    kind: str  # int long float double string null bool


@dataclass(frozen=True)
class Name(Expr):
    table: str | None
    column: str


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None


@dataclass(frozen=True)
class Binary(Expr):
    """Arithmetic or comparison."""

    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Negate(Expr):
    operand: Expr


@dataclass(frozen=True)
class Logic(Expr):
    """AND or OR of two or more."""

    op: str
    operands: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    operand: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    operand: Expr
    negated: bool


@dataclass(frozen=True)
class Call(Expr):
    name: str  # upper case
    distinct: bool
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Subquery(Expr):
    select: Select


@dataclass(frozen=True)
class Like(Expr):
    operand: Expr
    pattern: Expr


@dataclass(frozen=True)
class In(Expr):
    """One of several values, or of the rows of a query."""

    operand: Expr
    among: tuple


@dataclass(frozen=True)
class Exists(Expr):
    select: Select


@dataclass(frozen=True)
class Case(Expr):
    arms: tuple[tuple[Expr, Expr], ...]
    other: Expr


@dataclass(frozen=True)
class Cast(Expr):
    operand: Expr
    kind: str
    sizes: tuple[int, ...]


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class Base:
    table: str
    alias: str | None


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    how: str  # inner cross left right full semi anti
    natural: bool = False
    using: tuple[str, ...] | None = None
    on: Expr | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    distinct: bool = False
    source: object | None = None
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, str, tuple[int, ...]], ...]
    temporary: bool
    if_not_exists: bool


@dataclass(frozen=True)
class CreateView:
    name: str
    select: Select


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Explain:
    select: Select


@dataclass(frozen=True)
class Show:
    what: str


def children(e: Expr) -> tuple[Expr, ...]:
    """Direct operands; a subquery is opaque."""
    match e:
        case Binary(_, a, b):
            return (a, b)
        case Negate(a) | Not(a) | IsNull(a, _):
            return (a,)
        case Logic(_, many):
            return many
        case Like(a, b):
            return (a, b)
        case In(a, among):
            return (a, *(x for x in among if isinstance(x, Expr)))
        case Case(arms, other):
            return (*(x for arm in arms for x in arm), other)
        case Cast(a, _, _):
            return (a,)
        case Call(_, _, args):
            return args
    return ()


def walk(e: Expr):
    """e and all below it, outermost first."""
    yield e
    for c in children(e):
        yield from walk(c)


def conjuncts(e: Expr):
    """The conditions that AND puts together, in order."""
    if isinstance(e, Logic) and e.op == "AND":
        for x in e.operands:
            yield from conjuncts(x)
    else:
        yield e
