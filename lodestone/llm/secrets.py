"""Secret scans by a trigram index, in DataFrame operations only.

Each rule's regular expression is parsed on the driver into a Boolean query over the trigrams that every match must have. The index
of a row is a bitmap: bit t says that the row is in the posting list of trigram t, of the trigrams that any query names
(`posting_lists` turns it into lists). Intersecting and uniting postings are bitwise operations on the bitmap, beside the
text, so that candidates are verified where they stand and no text is shuffled. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import let, pick, spread, table


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression that Java and Python read alike. checked: a group that must have `least` characters, and how many; failing matches are dropped after matching. scan: a pattern whose matches are just those that pass."""

    kind: str
    pattern: str
    checked: int = 0
    least: int = 0
    scan: str = ""


#: Fixed values of the contract.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12,}"),  # a run that fails from its first AKIA on fails from any later one
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}"),
)
#: Published shapes of other secrets, without upper bounds: a longer run is taken whole, so that nothing of a key is left behind.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
)
RULES = BASE + ADDED

Query = list[list[frozenset[str]]]  # all of: any of: all of these trigrams


def trigram_query(pattern: str, most: int = 64, wide: int = 10) -> Query:
    """The trigrams, lower-cased, that a text must have to match: an AND of ORs of ANDs; empty if none are mandatory."""

    def grams(strings: set[str]) -> list[frozenset[str]] | None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        return None if frozenset() in sets else sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)

    def walk(nodes: list) -> tuple[set[str] | None, Query]:
        """The strings that nodes match if they are few, and else what matching them demands."""
        query: Query = []
        run, exact = {""}, True

        def flush(to: set[str]) -> None:
            nonlocal run
            if (g := grams(run)) and g not in query:
                query.append(g)
            run = to

        for kind, value in nodes:
            some: set[str] | None = None
            inner: Query = []
            if kind is op.LITERAL:
                some = {chr(value).lower()}
            elif kind is op.IN:
                chars = [c for k, v in value for c in ([v] if k is op.LITERAL else range(v[0], v[1] + 1) if k is op.RANGE else [None] * 99)]
                some = {chr(c).lower() for c in chars} if len(chars) <= wide else None
            elif kind is op.SUBPATTERN:
                some, inner = walk(list(value[3]))
            elif kind is op.BRANCH:
                each = [walk(list(x)) for x in value[1]]
                if all(s is not None for s, _ in each):
                    some = set().union(*(s for s, _ in each))
                elif all(q or (s is not None and grams(s)) for s, q in each):
                    inner = [[f for s, q in each for f in (q[0] if q else grams(s))]]
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, high, body = value
                s, q = walk(list(body))
                if s is not None and low == 0 and high == 1:
                    some = s | {""}
                elif s is not None and low and len(s) ** low <= most:
                    strings = {""}
                    for _ in range(low):
                        strings = {a + b for a in strings for b in s}
                    if low == high:
                        some = strings
                    else:
                        inner = [g] if (g := grams(strings)) else []
                elif low:
                    inner = q
            elif kind is op.AT:
                some = {""}
            if some is not None and len(run) * len(some) <= most:
                run = {a + b for a in run for b in some}
            elif some is not None:
                flush(some)
                exact = False
            else:
                flush({""})
                query.extend(g for g in inner if g not in query)
                exact = False
        if exact:
            return run, []
        flush({""})
        return None, query

    strings, query = walk(list(parser.parse(pattern)))
    return query if strings is None else ([g] if (g := grams(strings)) else [])


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the queries name, in order: bit i of a row's bitmap is the i-th."""
    return sorted({t for r in rules for any_of in trigram_query(r.pattern) for all_of in any_of for t in all_of})


def bitmap(lower: Column, grams: list[str]) -> list[Column]:
    """The row's bits, 60 in a bigint."""
    return [
        reduce(lambda a, b: a.bitwiseOR(b), [F.when(lower.contains(t), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, t in enumerate(grams[at : at + 60])])
        for at in range(0, len(grams), 60)
    ]


def candidate(rule: Rule, grams: list[str]) -> Column:
    """Whether the row is in the postings that the rule's query leaves; for a rule without trigrams a scan for its shortest match."""

    def has(all_of: frozenset[str]) -> Column:
        need = [sum(1 << (grams.index(t) - at) for t in all_of if at <= grams.index(t) < at + 60) for at in range(0, len(grams), 60)]
        return reduce(lambda a, b: a & b, [F.col(f"bits{i}").bitwiseAND(n) == n for i, n in enumerate(need) if n])

    query = trigram_query(rule.pattern)
    if not query:
        return F.col("text").rlike(rule.scan or rule.pattern)
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [has(x) for x in any_of]) for any_of in query])


#: Elements that are folded into one array at once: appending copies the array, so long ones are folded chunk by chunk and put together once.
CHUNK = 32


def chunked(items: Column) -> Column:
    """The array cut into arrays of CHUNK elements; an empty one is a single empty chunk."""
    last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def scanned(items: Column, carry: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], empty: str) -> Column:
    """Flat array of emit(a, item), an array, over the items in order; a is an int that starts at 0 and goes through carry(a, item)."""

    def per_chunk(chunks: Column) -> Column:
        fold = lambda a, c: F.aggregate(c, a, carry)
        begins = F.aggregate(chunks, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(fold(F.element_at(a, -1), c))))
        step = lambda a, x: F.struct(carry(a["at"], x).alias("at"), F.concat(a["out"], emit(a["at"], x)).alias("out"))
        one = lambda c, begin: F.aggregate(c, F.struct(begin.alias("at"), F.expr(empty).alias("out")), step, lambda a: a["out"])
        return let(begins, lambda b: F.transform(chunks, lambda c, i: one(c, F.get(b, i))))

    return F.flatten(let(items, lambda held: let(chunked(held), per_chunk)))


SPANS = "cast(array() as array<struct<start:int,kind:int,end:int>>)"
GAPS = "cast(array() as array<struct<start:int,end:int>>)"


def matches(rule: Rule, order: int) -> Column:
    r"""Spans (start, order, end) of the rule's leftmost matches that don't overlap, in code points.

    Each match is extracted with the gap before it, so that the lengths so far give its place. \G ties a gap to the
    end of the match before, which keeps the work in proportion to the text.
    """
    whole = F.lit(rf"\G(?s:(.*?))({rule.scan or rule.pattern})")
    lengths = lambda g: F.transform(F.regexp_extract_all("text", whole, F.lit(g)), F.length)
    parts = F.arrays_zip(lengths(1).alias("gap"), lengths(2).alias("own"), lengths(2 + rule.checked).alias("checked"))
    span = lambda a, p: F.struct((a + p["gap"]).alias("start"), F.lit(order).alias("kind"), (a + p["gap"] + p["own"]).alias("end"))
    return scanned(
        parts.cast("array<struct<gap:int,own:int,checked:int>>"),
        lambda a, p: a + p["gap"] + p["own"],
        lambda a, p: F.when(p["checked"] >= rule.least, F.array(span(a, p))).otherwise(F.expr(SPANS)),
        SPANS,
    )


def indexed(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, text) -> the same, with the bitmap."""
    grams = vocabulary(rules)
    lower = rows.select("row", F.coalesce("text", F.lit("")).alias("text")).withColumn("lower", F.lower("text"))
    return lower.select("row", "text", *[c.alias(f"bits{i}") for i, c in enumerate(bitmap(F.col("lower"), grams))])


def posting_lists(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index: (trigram, doc_id), a row for each trigram of the rules' queries and row that has it."""
    grams = vocabulary(rules)
    own = pick(docs, "doc_id", "text")
    index = indexed(own.select(F.struct("doc_id").alias("row"), F.col("text").cast("string").alias("text")), rules)
    held = [F.when(F.col(f"bits{i // 60}").bitwiseAND(1 << i % 60) != 0, F.lit(t)) for i, t in enumerate(grams)]
    return index.select(F.explode(F.array_compact(F.array(*held))).alias("trigram"), F.col("row.doc_id").alias("doc_id"))


def with_spans(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, text) -> (row, text, found): the spans of all rules by start and the rules' order; null text counts as empty."""
    grams = vocabulary(rules)
    flags = indexed(rows, rules).select("row", "text", *[candidate(r, grams).alias(f"may{i}") for i, r in enumerate(rules)])
    each = flags.select("row", "text", *[F.when(F.col(f"may{i}"), matches(r, i)).otherwise(F.expr(SPANS)).alias(f"spans{i}") for i, r in enumerate(rules)])
    return each.select("row", "text", F.sort_array(F.concat(*[f"spans{i}" for i in range(len(rules))])).alias("found"))


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of docs.

    rules start with BASE. Null texts count as empty; a text without secrets has no spans and the hash of the empty
    string. Nothing is grouped, so repeated rows and null ids are scanned each for itself. Other columns are ignored.
    """
    own = pick(docs, "doc_id", "text")
    found = with_spans(own.select(F.struct("doc_id").alias("row"), F.col("text").cast("string").alias("text")), rules).select("row", "found")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base, rules), 256).alias("base_sha256"), written(F.col("found"), rules).alias("spans"),
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in the text replaced by mark (spans that overlap are one); n_chars, if there, is the new length."""
    cols = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    at = cols.index("text") if "text" in cols else [c.lower() for c in cols].index("text")
    rows = flat.select(F.struct(*flat.columns).alias("row"), F.col(f"c{at}").cast("string").alias("text"))
    found = with_spans(rows, rules)
    text = F.expr("row." + f"c{at}")
    # What stands between the secrets, each piece before its mark; a chunk of pieces is cut out of the text before its pieces are.
    gaps = scanned(
        F.col("found"),
        lambda a, s: F.greatest(a, s["end"]),
        lambda a, s: F.when(s["start"] >= a, F.array(F.struct(a.alias("start"), s["start"].alias("end")))).otherwise(F.expr(GAPS)),
        GAPS,
    )

    def pieces(chunk: Column) -> Column:
        lo, hi = F.element_at(chunk, 1)["start"], F.element_at(chunk, -1)["end"]
        return let(F.substring(F.col("text"), lo + 1, hi - lo), lambda t: F.transform(chunk, lambda g: F.concat(F.substring(t, g["start"] - lo + 1, g["end"] - g["start"]), F.lit(mark))))

    before = F.array_join(F.flatten(let(gaps, lambda g: F.transform(chunked(g), pieces))), "")
    last = F.aggregate("found", F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    cut = F.concat(before, F.substring(F.col("text"), last + 1, F.length("text")))
    out = found.select("row", F.when(F.size("found") > 0, cut).otherwise(text).alias("clean"))
    return out.select(*[(F.col("clean") if i == at else F.when(F.col("clean").isNull(), F.col(f"row.c{i}")).otherwise(F.length("clean").cast("bigint")) if c == "n_chars" else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(cols)])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spread(table(spark, sf_dir, "documents")))


def _oracle(rules: tuple[Rule, ...]) -> str:
    def spans(i: int, r: Rule) -> str:
        full = f"(?s:(.*?))({r.pattern})".replace("'", "''")
        part = lambda g: f"list_transform(regexp_extract_all(text, '{full}', {g}), lambda x: len(x))"
        return f"{part(1)} as g{i}, {part(2)} as m{i}, {part(2 + r.checked)} as v{i}"

    def listed(i: int, r: Rule) -> str:
        start = f"coalesce(list_sum(g{i}[1:k]), 0) + coalesce(list_sum(m{i}[1:k-1]), 0)"
        return f"list_transform(list_filter(generate_series(1, len(m{i})), lambda k: v{i}[k] >= {r.least}), lambda k: {{'s': cast({start} as bigint), 'o': {i}, 'e': cast({start} + m{i}[k] as bigint)}})"

    said = "list_transform({}, lambda x: [" + ", ".join(f"'{r.kind}'" for r in rules) + "][x.o + 1] || ':' || x.s || ':' || x.e)"
    base = said.format("list_filter(f, lambda x: x.o < 3)")
    n = lambda k: f"cast(len(list_filter(f, lambda x: x.o = {k})) as bigint)"
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
m as (select doc_id, {", ".join(spans(i, r) for i, r in enumerate(rules))} from d),
f as (select doc_id, list_sort(list_concat({", ".join(listed(i, r) for i, r in enumerate(rules))})) as f from m)
select doc_id, {n(0)} as n_assign, {n(1)} as n_access, {n(2)} as n_hex, sha256(array_to_string({base}, ',')) as base_sha256, array_to_string({said.format("f")}, ',') as spans from f
"""


OP5_SQL = _oracle(RULES)
