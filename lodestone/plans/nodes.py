"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: object
    text: str = ""


@dataclass(frozen=True)
class Path(Expr):
    """A dotted name; `*` and `**` among the parts are wildcards."""

    parts: tuple[str, ...]

    @property
    def wild(self) -> bool:
        return "*" in self.parts or "**" in self.parts


@dataclass(frozen=True)
class Param(Expr):
    index: int


@dataclass(frozen=True)
class Document(Expr):
    fields: tuple[tuple[tuple[str, ...], Expr], ...]


@dataclass(frozen=True)
class Array(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # NOT or -
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # AND OR = != < <= > >= + - * /
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    arg: Expr
    pattern: Expr
    negated: bool


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class In(Expr):
    arg: Expr
    items: tuple[Expr, ...] | Select
    negated: bool


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    to: str


@dataclass(frozen=True)
class Aggregate(Expr):
    name: str
    arg: Expr | None  # None: COUNT(*)
    distinct: bool = False


@dataclass(frozen=True)
class Subquery(Expr):
    select: Select


@dataclass(frozen=True)
class Sequence(Expr):
    name: str
    draw: str  # NEXTVAL or CURRVAL


@dataclass(frozen=True)
class Star(Expr):
    of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    alias: str
    on: Expr


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    alias: str
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Path, ...] = ()
    having: Expr | None = None
    order: tuple[tuple[Expr, bool], ...] = ()  # (expression, descending)
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    hints: tuple[tuple[str, str | None], ...] = ()


@dataclass(frozen=True)
class Union:
    left: Select | Union
    right: Select
    all: bool


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[Document, ...] = ()
    select: Select | Union | None = None
    replace: bool = False


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[tuple[str, ...], Expr], ...]
    where: Expr | None
    hints: tuple = ()


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None
    hints: tuple = ()


@dataclass(frozen=True)
class Truncate:
    table: str


@dataclass(frozen=True)
class Create:
    kind: str  # VIEW SEQUENCE INDEX
    name: str
    text: str = ""
    path: str = ""
    options: dict = field(default_factory=dict, hash=False)
    lenient: bool = False


@dataclass(frozen=True)
class Drop:
    kind: str  # VIEW SEQUENCE INDEX TABLE
    name: str
    path: str = ""
    lenient: bool = False


@dataclass(frozen=True)
class Explain:
    statement: object


def children(e: Expr) -> list[Expr]:
    """The expressions directly below, without those of subqueries."""
    match e:
        case Unary(_, a) | IsNull(a, _) | Cast(a, _):
            return [a]
        case Binary(_, a, b) | Like(a, b, _):
            return [a, b]
        case Between(a, b, c, _):
            return [a, b, c]
        case In(a, items, _):
            return [a, *(items if isinstance(items, tuple) else ())]
        case Case(whens, default):
            return [x for w in whens for x in w] + ([default] if default else [])
        case Call(_, args) | Array(args):
            return list(args)
        case Aggregate(_, arg, _):
            return [arg] if arg else []
        case Document(fields):
            return [v for _, v in fields]
    return []


def has_aggregate(e: Expr) -> bool:
    return isinstance(e, Aggregate) or any(has_aggregate(c) for c in children(e))
