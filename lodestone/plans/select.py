"""SELECT to Spark SQL text. Catalyst plans and decorrelates; this module only resolves names and writes the rules down."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import types as T

from lodestone.functions.aggregate import aggregate
from lodestone.functions.scalar import call
from lodestone.plans import nodes as n
from lodestone.plans import values as v
from lodestone.plans.parser import DialectError
from lodestone.plans.values import Value, quoted

#: Columns that the engine keeps for itself.
HIDDEN = "_rid"


class Tables(Protocol):
    def source(self, name: str) -> tuple[str, T.StructType]:
        """What stands for the collection or view in Spark SQL, and its schema; an unknown one is empty."""


@dataclass
class Source:
    """alias: its name in the dialect; own: its name in Spark SQL, which no other source of the statement has, so that a subquery over the same collection reads its own rows."""

    alias: str
    schema: T.StructType
    own: str = ""

    @property
    def name(self) -> str:
        return quoted(self.own or self.alias)

    def column(self, parts: tuple[str, ...]) -> Value | None:
        """None if the first part isn't a column; null if a later one isn't a field."""
        f = next((f for f in self.schema if f.name == parts[0]), None)
        if f is None:
            return None
        sql, type_ = f"{self.name}.{quoted(f.name)}", f.dataType
        for k, p in enumerate(parts[1:], 1):
            if isinstance(type_, T.VariantType):
                return Value(f"try_variant_get({sql}, {v.text('$.' + '.'.join(parts[k:]))}, 'variant')", T.VariantType())
            sub = next((s for s in type_ if s.name == p), None) if isinstance(type_, T.StructType) else None
            if sub is None:
                return v.NULL
            sql, type_ = f"{sql}.{quoted(p)}", sub.dataType
        return Value(sql, type_)


@dataclass
class Scope:
    """Names in reach. grouped: in a grouped query, keys and aggregates stand for themselves and all else is null."""

    sources: list[Source]
    outer: Scope | None = None
    grouped: dict[n.Expr, Value] = field(default_factory=dict)
    is_grouped: bool = False
    aliases: dict[str, Value] = field(default_factory=dict)

    def path(self, parts: tuple[str, ...]) -> Value:
        found = self.local(parts)
        if found is not None:
            return found
        scope = self.outer
        while scope:  # outer rows are named by their alias only
            if len(parts) > 1 and any(s.alias == parts[0] for s in scope.sources):
                return scope.local(parts) or v.NULL
            scope = scope.outer
        return v.NULL

    def local(self, parts: tuple[str, ...]) -> Value | None:
        if self.is_grouped:
            for key in (n.Path(parts), *([n.Path(parts[1:])] if len(parts) > 1 and any(s.alias == parts[0] for s in self.sources) else [])):
                if key in self.grouped:
                    return self.grouped[key]
            tail = [val for k, val in self.grouped.items() if isinstance(k, n.Path) and k.parts[1:] == parts and any(s.alias == k.parts[0] for s in self.sources)]
            return tail[0] if tail else v.NULL
        aliased = [s for s in self.sources if len(parts) > 1 and s.alias == parts[0]]
        for s in aliased:
            if (found := s.column(parts[1:])) is not None:
                return found
        for s in reversed(self.sources):  # the right-most table with such a column
            if (found := s.column(parts)) is not None:
                return found
        return v.NULL if aliased else None

    def wild(self, parts: tuple[str, ...]) -> list[Value]:
        """The scalars that a path with `*` (children) or `**` (any depth) reaches."""
        sources = [s for s in self.sources if len(parts) > 1 and s.alias == parts[0]]
        if sources:
            parts = parts[1:]
        out: list[Value] = []

        def walk(sql: str, type_: T.DataType, rest: tuple[str, ...]) -> None:
            if not rest:
                if not isinstance(type_, T.StructType):
                    out.append(Value(sql, type_))
                return
            if not isinstance(type_, T.StructType):
                return
            head, tail = rest[0], rest[1:]
            for f in type_:
                at = f"{sql}.{quoted(f.name)}"
                if head == "*" or head == f.name:
                    walk(at, f.dataType, tail)
                elif head == "**":
                    if tail:
                        walk(sql, T.StructType([f]), tail)
                        walk(at, f.dataType, rest)
                    else:
                        walk(at, f.dataType, () if not isinstance(f.dataType, T.StructType) else rest)

        for s in sources or reversed(self.sources):
            visible = T.StructType([f for f in s.schema if f.name != HIDDEN])
            if parts[0] in ("*", "**") or any(f.name == parts[0] for f in visible):
                walk(s.name, visible, parts)
                break
        return list(dict.fromkeys(out))


class Compiler:
    """Compiles one statement. params: values of `?`; draw: what a sequence yields, where that has a meaning."""

    def __init__(self, tables: Tables, params: tuple = (), draw=None):
        self.tables, self.params, self.draw, self.names = tables, params, draw, 0

    # Expressions

    def value(self, e: n.Expr, s: Scope) -> Value:
        if s.is_grouped and e in s.grouped:
            return s.grouped[e]
        match e:
            case n.Literal(value, _):
                return v.literal(value)
            case n.Param(i):
                return v.literal(self.params[i])
            case n.Path(parts):
                if e.wild:
                    raise DialectError("a wildcard stands only in predicates")
                return s.path(parts)
            case n.Binary(op, a, b) if op in "+-*/":
                return v.arithmetic(op, self.value(a, s), self.value(b, s))
            case n.Unary("-", a):
                x = self.value(a, s)
                return v.arithmetic("-", v.literal(0), x)
            case n.Binary() | n.Unary() | n.Between() | n.Like() | n.IsNull() | n.In():
                return v.boolean(self.predicate(e, s, False))
            case n.Case(whens, default):
                parts = [(self.predicate(c, s, True), self.value(x, s)) for c, x in whens]
                other = self.value(default, s) if default else v.NULL
                type_ = v.common([x.type for _, x in parts] + [other.type])
                said = v.as_string if type_ is None else (lambda x: x.sql)
                body = " ".join(f"WHEN {c} THEN {said(x)}" for c, x in parts)
                return Value(f"CASE {body} ELSE {said(other)} END", T.StringType() if type_ is None else type_)
            case n.Call(name, args):
                return call(name, [self.value(a, s) for a in args])
            case n.Cast(a, to):
                return self.cast(self.value(a, s), to)
            case n.Aggregate():
                raise DialectError(f"{e.name} has no meaning here")
            case n.Subquery(select):
                return self.scalar(select, s)
            case n.Document(fields):
                each = [(".".join(k), self.value(x, s)) for k, x in fields]
                type_ = T.StructType([T.StructField(k, x.type) for k, x in each])
                return Value(f"named_struct({', '.join(f'{v.text(k)}, {x.sql}' for k, x in each)})", type_)
            case n.Array(items):
                each = [self.value(x, s) for x in items]
                type_ = v.common([x.type for x in each])
                said = v.as_string if type_ is None else (lambda x: x.sql)
                return Value(f"array({', '.join(map(said, each))})", T.ArrayType(T.StringType() if type_ is None else type_))
            case n.Sequence(name, how):
                if self.draw is None:
                    raise DialectError("a sequence is drawn from only in INSERT and UPDATE")
                return v.literal(self.draw(name, how))
        raise DialectError(f"{type(e).__name__} has no value")

    @staticmethod
    def cast(x: Value, to: str) -> Value:
        kinds = {"INTEGER": "BIGINT", "INT": "BIGINT", "BIGINT": "BIGINT", "REAL": "DOUBLE", "DOUBLE": "DOUBLE", "FLOAT": "DOUBLE", "TEXT": "STRING", "STRING": "STRING", "BOOLEAN": "BOOLEAN", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP_NTZ"}
        if to.upper() not in kinds:
            raise DialectError(f"no type {to}")
        name = kinds[to.upper()]
        if name == "STRING":
            return Value(v.as_string(x), T.StringType())
        types = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP_NTZ": T.TimestampNTZType()}
        return Value(f"try_cast({x.sql} AS {name})", types[name])

    def predicate(self, e: n.Expr, s: Scope, positive: bool, joining: bool = False) -> str:
        """A condition without null; positive: null means false where it stands. joining: an ON condition's top level."""
        match e:
            case n.Binary("AND" | "OR", a, b):
                keep = joining and e.op == "AND"
                return f"({self.predicate(a, s, positive, keep)} {e.op} {self.predicate(b, s, positive, keep)})"
            case n.Unary("NOT", a):
                return f"(NOT {self.predicate(a, s, False)})"
            case n.Binary(op, a, b) if op in ("=", "!=", "<", "<=", ">", ">="):
                if isinstance(a, n.Path) and a.wild:
                    return self.any_of(a, s, lambda x: self.compare(op, x, self.value(b, s), positive, False))
                return self.compare(op, self.value(a, s), self.value(b, s), positive, joining)
            case n.Between(a, low, high, negated):
                test = lambda x: v.between(x, self.value(low, s), self.value(high, s), positive and not negated)
                return self.negate(self.any_of(a, s, test) if isinstance(a, n.Path) and a.wild else test(self.value(a, s)), negated)
            case n.Like(a, pattern, negated):
                p = self.value(pattern, s)
                if p.kind != "str" or not isinstance(pattern, n.Literal | n.Param):
                    raise DialectError("LIKE takes a string literal")
                said = str(pattern.value if isinstance(pattern, n.Literal) else self.params[pattern.index])
                if isinstance(a, n.Path) and a.wild:
                    return self.negate(self.any_of(a, s, lambda x: v.like(x, said, False, False) if x.kind == "str" else None), negated)
                return v.like(self.value(a, s), said, negated, positive)
            case n.IsNull(a, negated):
                if isinstance(a, n.Path) and a.wild:
                    return self.any_of(a, s, lambda x: self.negate(v.is_null(x), negated))
                return self.negate(v.is_null(self.value(a, s)), negated)
            case n.In(a, items, negated):
                if isinstance(items, n.Select):
                    return self.negate(self.member(self.value(a, s), items, s), negated)
                test = lambda x: self.among(x, [self.value(i, s) for i in items], positive and not negated)
                return self.negate(self.any_of(a, s, test) if isinstance(a, n.Path) and a.wild else test(self.value(a, s)), negated)
            case n.Path() if e.wild:
                return self.any_of(e, s, lambda x: v.truthy(x, positive))
        return v.truthy(self.value(e, s), positive)

    @staticmethod
    def negate(sql: str, negated: bool) -> str:
        return f"(NOT {sql})" if negated else sql

    @staticmethod
    def compare(op: str, a: Value, b: Value, positive: bool, joining: bool) -> str:
        if op == "=":
            return v.equal(a, b, positive, joining)
        if op == "!=":
            return f"(NOT {v.equal(a, b, False)})"
        return v.ordered(op, a, b, positive)

    @staticmethod
    def any_of(path: n.Path, s: Scope, test) -> str:
        """Whether any value that the path reaches passes; values that no document has don't count."""
        each = []
        for x in s.wild(path.parts):
            said = test(x)
            if said is not None:
                each.append(f"({x.sql} IS NOT NULL AND {said})" if "IS NULL" not in said else said)
        return f"coalesce({' OR '.join(each)}, FALSE)" if each else "FALSE"

    @staticmethod
    def among(x: Value, items: list[Value], positive: bool) -> str:
        plain = [i for i in items if i.literal and i.kind == x.kind and x.kind in ("int", "str", "float")]
        rest = [i for i in items if i not in plain]
        each = [v.equal(x, i, positive) for i in rest]
        if plain:
            each.append(v.sure(f"{x.sql} IN ({', '.join(i.sql for i in plain)})", positive and not rest))
        return f"({' OR '.join(each)})" if each else "FALSE"

    def member(self, x: Value, select: n.Select, s: Scope) -> str:
        """x IN (SELECT ...), as EXISTS: Spark makes a semi or anti join of it, in which null meets null."""
        first = n.Select(select.items[:1], *[getattr(select, f) for f in ("table", "alias", "joins", "where", "group", "having", "order", "limit", "offset", "distinct", "hints")])
        if isinstance(first.items[0].expr, n.Star):
            _, schema = self.tables.source(first.table)
            names = [f.name for f in schema if f.name != HIDDEN]
            if not names:
                return "FALSE"
            first = n.Select((n.Item(n.Path((names[0],)), None),), *[getattr(first, f) for f in ("table", "alias", "joins", "where", "group", "having", "order", "limit", "offset", "distinct", "hints")])
        simple = not (first.group or first.limit is not None or first.offset or n.has_aggregate(first.items[0].expr))
        if simple:
            sources, scope = self.sources(first, s)
            y = self.value(first.items[0].expr, scope)
            where = f" AND {self.predicate(first.where, scope, True)}" if first.where else ""
            return f"EXISTS (SELECT 1 FROM {sources} WHERE {self.same(x, y)}{where})"
        sql, outputs = self.select(first, s)
        own = self.fresh("in")
        return f"EXISTS (SELECT 1 FROM ({sql}) AS {own} WHERE {self.same(x, Value(f'{own}.{quoted(outputs[0][0])}', outputs[0][1]))})"

    @staticmethod
    def same(x: Value, y: Value) -> str:
        both = None if "null" in (x.kind, y.kind) else v.matched(x, y)
        return f"{both[0]} <=> {both[1]}" if both else v.equal(x, y, False)

    def fresh(self, stem: str) -> str:
        """A name that nothing else in the statement has."""
        self.names += 1
        return quoted(f"__{stem}{self.names}")

    def scalar(self, select: n.Select, s: Scope) -> Value:
        """The first field of the first row, or null."""
        if not isinstance(select.items[0].expr, n.Star):
            select = n.Select(select.items[:1], *[getattr(select, f) for f in ("table", "alias", "joins", "where", "group", "having", "order", "limit", "offset", "distinct", "hints")])
        sql, outputs = self.select(select, s, bound=True)
        if not outputs:
            return v.NULL
        if len(outputs) > 1:
            sql = f"SELECT {quoted(outputs[0][0])} FROM ({sql})"
        one = Value(f"({sql})", outputs[0][1])
        return v.NULL if one.kind in ("doc", "list") else one

    # Clauses

    def sources(self, q: n.Select, outer: Scope | None) -> tuple[str, Scope]:
        """The FROM clause, and the scope of what it yields."""
        hints = {h for h, _ in q.hints}
        scope, said = Scope([], outer), ""
        for k, (kind, table, alias, on) in enumerate([("", q.table, q.alias, None), *[(j.kind, j.table, j.alias, j.on) for j in q.joins]]):
            if any(x.alias == alias for x in scope.sources):
                raise DialectError(f"{alias} is named twice; give it another alias")
            name, schema = self.tables.source(table)
            source = Source(alias, schema, self.fresh("s").strip("`"))
            scope.sources.append(source)
            spread = next((a for h, a in q.hints if h == "PARALLEL"), None) if "PARALLEL" in hints and k == 0 else None
            if "PARALLEL" in hints and k == 0:
                name = f"(SELECT /*+ REPARTITION({int(spread or 4)}) */ * FROM {name})"
            said += f"{name} AS {source.name}" if not k else f" {kind} JOIN {name} AS {source.name} ON {self.predicate(on, scope, True, joining=True)}"
        return said, scope

    def hint(self, q: n.Select, scope: Scope) -> str:
        """NESTED_LOOP is a label of EXPLAIN: a join of every pair is planned only where the condition leaves no other way."""
        if not q.joins or "HASH_JOIN" not in {h for h, _ in q.hints}:
            return ""
        return f"/*+ SHUFFLE_HASH({', '.join(x.name for x in scope.sources[1:])}) */ "

    def select(self, q: n.Select, outer: Scope | None = None, bound: bool = False) -> tuple[str, list[tuple[str, T.DataType]]]:
        """The text and its columns. bound: at most one row is wanted."""
        said, scope = self.sources(q, outer)
        where = f" WHERE {self.predicate(q.where, scope, True)}" if q.where else ""
        items = list(q.items)
        grouped = bool(q.group) or any(n.has_aggregate(i.expr) for i in items)
        if grouped:
            if not q.group:
                items = [i for i in items if n.has_aggregate(i.expr)]
            said, scope = self.group(q, items, said + where, scope)
            where = f" WHERE {self.predicate(q.having, scope, True)}" if q.having else ""
        outputs: dict[str, Value] = {}
        for name, x in self.outputs(items, scope, q):
            outputs[name] = x
        if not outputs:
            outputs["expr"] = v.NULL
        hint = "" if grouped else self.hint(q, scope)
        columns = ", ".join(f"{x.sql} AS {quoted(name)}" for name, x in outputs.items())
        keys, hidden = self.order(q, scope, outputs)
        if q.distinct and (hidden or any(not groupable(x.type) for x in outputs.values())):
            sql = self.distinct(f"SELECT {hint}{', '.join([columns, *(f'{x} AS {name}' for name, x, _ in hidden)])} FROM {said}{where}", outputs, hidden)
        else:
            sql = f"SELECT {hint}{'DISTINCT ' if q.distinct else ''}{columns} FROM {said}{where}"
        if keys:
            sql += f" ORDER BY {', '.join(keys)}"
        one = bound and not (grouped and not q.group)
        if q.limit is not None or one:
            sql += f" LIMIT {min(q.limit, 1) if one and q.limit is not None else 1 if one else max(q.limit, 0)}"
        if q.offset:
            sql += f" OFFSET {q.offset}"
        return sql, [(name, x.type) for name, x in outputs.items()]

    def order(self, q: n.Select, scope: Scope, outputs: dict[str, Value]) -> tuple[list[str], list[tuple[str, str, bool]]]:
        """Sort keys, and those that a DISTINCT query sorts by without showing them: (name, what it is, descending)."""
        keys: list[str] = []
        hidden: list[tuple[str, str, bool]] = []
        for e, descending in q.order:
            if isinstance(e, n.Literal):
                continue
            if isinstance(e, n.Path) and ".".join(e.parts) in outputs:
                name = ".".join(e.parts)
                x, shown = Value(quoted(name), outputs[name].type), True
            else:
                x = self.value(e, scope)
                name = next((k for k, o in outputs.items() if o.sql == x.sql), None) if q.distinct else None
                x, shown = (Value(quoted(name), x.type), True) if name else (x, False)
            if x.kind == "null":
                continue
            for sql in v.rank(x) if x.kind == "variant" else [v.as_string(x)] if x.kind in ("doc", "list") else [x.sql]:
                if q.distinct and not shown:
                    hidden.append((self.fresh("o"), sql, descending))
                    sql = hidden[-1][0]
                keys.append(f"{sql}{' DESC' if descending else ''}")
        return keys, hidden

    def distinct(self, sql: str, outputs: dict[str, Value], hidden: list[tuple[str, str, bool]]) -> str:
        """The rows of sql that differ in kind or content, with one original of each; hidden sort keys are those of the row that sorts first."""
        if len({d for _, _, d in hidden}) > 1:
            raise DialectError("ORDER BY fields that DISTINCT doesn't select must all ascend or all descend")
        shown = {name: Value(quoted(name), x.type) for name, x in outputs.items()}
        keys = [v.identity(x) for x in shown.values()]
        first = f"{'max' if any(d for _, _, d in hidden) else 'min'}(struct({', '.join(name for name, _, _ in hidden)}))" if hidden else ""
        own = [f"any_value({x.sql}) AS {x.sql}" for x in shown.values()]
        own += [f"{first}.{name} AS {name}" for name, _, _ in hidden]
        inner = f"SELECT {', '.join(own)} FROM ({sql}) GROUP BY {', '.join(keys)}"
        return f"SELECT {', '.join(x.sql for x in shown.values())} FROM ({inner})"

    def group(self, q: n.Select, items: list[n.Item], said: str, scope: Scope) -> tuple[str, Scope]:
        """The grouped rows as a derived table: keys and every aggregate that a later clause names."""
        columns, keys, known = [], [], {}
        own = self.fresh("g")
        for k, path in enumerate(q.group):
            x = scope.path(path.parts)
            if x.kind == "variant":  # grouped by the canonical string; a number stands for itself and the texts that say it
                columns.append(f"min_by({x.sql}, struct({', '.join(v.rank(x))})) AS `k{k}`")
                keys.append(f"if({v.is_null(x)}, NULL, {v.as_string(x)})")
            else:
                x = Value(v.as_string(x), T.StringType()) if x.kind in ("doc", "list") else x
                columns.append(f"{x.sql} AS `k{k}`")
                keys += [x.sql] if x.kind != "null" else []
            known[path] = Value(f"{own}.`k{k}`", x.type)
        wanted: dict[n.Aggregate, None] = {}

        def gather(e: n.Expr) -> None:
            if isinstance(e, n.Aggregate):
                wanted[e] = None
            else:
                for c in n.children(e):
                    gather(c)

        for e in [i.expr for i in items] + ([q.having] if q.having else []) + [e for e, _ in q.order]:
            gather(e)
        one = scope.sources[0] if len(scope.sources) == 1 else None
        first = f"{one.name}.{quoted(HIDDEN)}" if one and any(f.name == HIDDEN for f in one.schema) else None
        for k, a in enumerate(wanted):
            x = aggregate(a.name, self.value(a.arg, scope) if a.arg else None, a.distinct, first)
            columns.append(f"{x.sql} AS `a{k}`")
            known[a] = Value(f"{own}.`a{k}`", x.type)
        inner = f"SELECT {self.hint(q, scope)}{', '.join(columns) or '1 AS `k0`'} FROM {said}"
        if q.group:
            inner += f" GROUP BY {', '.join(keys) or '()'}"
            if not keys:
                inner += " HAVING count(1) > 0"
        out = Scope([Source(s.alias, s.schema, s.own) for s in scope.sources], scope.outer, known, True)
        for i in items:
            if i.alias and i.expr in known:
                known[n.Path((i.alias,))] = known[i.expr]
        return f"({inner}) AS {own}", out

    def outputs(self, items: list[n.Item], s: Scope, q: n.Select) -> list[tuple[str, Value]]:
        """Output columns in order; a later one of the same name takes the earlier one's place, but unnamed aggregates are told apart."""
        out: list[tuple[str, Value]] = []
        counts: dict[str, int] = {}

        def fields(source: Source) -> list[tuple[str, Value]]:
            return [(f.name, Value(f"{source.name}.{quoted(f.name)}", f.dataType)) for f in source.schema if f.name != HIDDEN]

        for i in items:
            e = i.expr
            if isinstance(e, n.Star):
                if s.is_grouped:
                    out += [(".".join(k.parts), x) for k, x in s.grouped.items() if isinstance(k, n.Path)]
                elif not e.of:
                    for source in s.sources:
                        each = fields(source)
                        if len(s.sources) > 1 and each:
                            said = ", ".join(f"{v.text(name)}, {x.sql}" for name, x in each)
                            out.append((source.alias, Value(f"named_struct({said})", T.StructType([T.StructField(name, x.type) for name, x in each]))))
                        out += each
                else:
                    source = next((x for x in s.sources if x.alias == e.of[0]), None)
                    if source and len(e.of) == 1:
                        out += fields(source)
                        continue
                    doc = s.path(e.of)
                    if isinstance(doc.type, T.StructType):
                        out += [(f.name, Value(f"{doc.sql}.{quoted(f.name)}", f.dataType)) for f in doc.type]
                continue
            name = i.alias or default_name(e, s)
            if not i.alias and isinstance(e, n.Aggregate):
                counts[name] = counts.get(name, 0) + 1
                name += f"_{counts[name]}" if counts[name] > 1 else ""
            out.append((name, self.value(e, s)))
        return out


def default_name(e: n.Expr, s: Scope | None = None) -> str:
    match e:
        case n.Path(parts):
            aliases = {x.alias for x in s.sources} if s else set()
            return ".".join(parts[1:] if len(parts) > 1 and len(aliases) == 1 and parts[0] in aliases else parts)
        case n.Call(name, _) | n.Aggregate(name, _, _):
            return name
        case n.Subquery():
            return "subquery"
        case n.Literal(_, text):
            return text
        case n.Binary(op, a, b) if op in "+-*/":
            return f"{default_name(a, s)}{op}{default_name(b, s)}"
        case n.Unary("-", a):
            return f"-{default_name(a, s)}"
    return "expr"


def groupable(t: T.DataType) -> bool:
    """Whether Spark can group by the type."""
    if isinstance(t, T.StructType):
        return all(groupable(f.dataType) for f in t)
    return groupable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, T.VariantType | T.MapType)
