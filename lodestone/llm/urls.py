"""URL filters: pattern rules indexed by their rarest literal token.

A rule's tokens are the runs of letters and digits that every URL it fits has whole. Each rule is filed under the one
that the fewest URLs of the table have, so the tokens of a URL fetch the few rules that may fit it, and only those
run their regular expressions. Rules without such a token are tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_pass, pick, table

TOKEN = r"[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)  # letters of other alphabets that lower-case to these are no part of a token


@dataclass(frozen=True)
class Rule:
    """pattern: `||` at its start stands for the host or a subdomain of it, `^` for a character that ends a token or the URL's end, `*` for anything; all else is literal. Without `||` the pattern may stand anywhere in the URL."""

    action: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    @cached_property
    def regex(self) -> re.Pattern:
        body = "".join(".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in self.name)
        return re.compile((r"\A(?:[^/]*\.)?" if self.pattern.startswith("||") else "") + body, re.S)

    def tokens(self) -> list[str]:
        """Those bounded on both sides: at the open ends of the pattern and beside `*` a run may go on in the URL."""
        found, body, anchored = [], self.name, self.pattern.startswith("||")
        for m in re.finditer(TOKEN, body.translate(_LOWERED)):
            left = body[m.start() - 1] != "*" if m.start() else anchored
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                found.append(m[0])
        return found


#: Fixed values of the contract: the longest that fits decides.
LISTED = (
    Rule("block", "||com/en/"), Rule("allow", "||example.com/en/7"), Rule("allow", "||net/de/"), Rule("block", "||example.net/de/8"), Rule("block", "||org/es/"),
)
#: The method's own, for URLs that no listed rule fits: any that fits blocks.
GENERAL = (
    Rule("block", "/adserver^"), Rule("block", "/ads/"), Rule("block", "/banner*.gif"), Rule("block", "/login^"), Rule("block", "/wp-admin/"),
    Rule("block", "||doubleclick.net^"), Rule("block", "/cgi-bin/*.exe^"), Rule("block", "/porn^"), Rule("block", "/casino^"),
)


def parts(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path, and what follows."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(_LOWERED), path, rest[len(host) + len(path) :]


def filed(pages: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by the token that the fewest URLs of the table have; those without one under the empty string. As many counts as tokens of rules reach the driver."""
    words = sorted({t for r in rules for t in r.tokens()})
    each = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate("url", UPPER, LOWER), F.lit(TOKEN), F.lit(0)))).alias("token"))
    seen = {r["token"]: r["count"] for r in each.where(F.col("token").isin(words)).groupBy("token").count().collect()}
    return by_rarest(rules, seen)


def by_rarest(rules: tuple[Rule, ...], seen: dict[str, int]) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens(), key=lambda t: (seen.get(t, 0), t), default=""), []).append(r)
    return out


def fetched(url: str, by_token: dict[str, list[Rule]]) -> set[Rule]:
    """The rules that the url's tokens bring, and those without a token."""
    return {r for t in {*re.findall(TOKEN, url.translate(_LOWERED)), ""} for r in by_token.get(t, ())}


def judged(pages: DataFrame, listed: tuple[Rule, ...] = LISTED, general: tuple[Rule, ...] = GENERAL) -> DataFrame:
    """pages (page_id, url, ...) -> (page_id, host, path, rule, verdict), a row for each row of pages.

    listed rules go by length, the longest first (among equals: the one listed first), before general ones; what none fits is allowed.
    A null url or one without `://` has an empty host and path and is allowed. Nothing is grouped, so repeated rows and
    null ids are judged each for itself. Other columns are ignored.
    """
    own = pick(pages, "page_id", "url").select("page_id", F.col("url").cast("string").alias("url"))
    by_token = filed(own, (*listed, *general))
    rank = {r: (0, -len(r.name), i) for i, r in enumerate(listed)} | {r: (1, 0, i) for i, r in enumerate(general)}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for url in batch.column(1).to_pylist():
            host, path, rest = parts(url)
            if not host:
                out.append((host, path, None, "allow"))
                continue
            fits = [r for r in sorted(fetched(host + path + rest, by_token), key=rank.__getitem__) if r.regex.search(host + path if r in listed else host + path + rest)]
            best = fits[0] if fits else None
            out.append((host, path, best.name if best in listed else None, best.action if best else "allow"))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.string()) for x in zip(*out, strict=True)]], ["page_id", "host", "path", "rule", "verdict"])

    schema = own.select("page_id").schema
    for c in ("host", "path", "rule", "verdict"):
        schema = schema.add(c, "string")
    return arrow_pass(own, run, schema)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    rules = " union all ".join(f"select '{r.action}' as action, '{r.name.partition('/')[0]}' as h, '/{r.name.partition('/')[2]}' as p" for r in LISTED)
    general = " or ".join(f"regexp_matches(host || path || rest, '{r.regex.pattern.replace(chr(92) + 'A', '^').replace(chr(92) + 'Z', '$')}')" for r in GENERAL)
    return f"""
with r as ({rules}),
u as (select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest0 from pages),
h as (select page_id, regexp_extract(rest0, '^[^/?#]*') as host0, rest0 from u),
a as (select page_id, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest0, length(host0) + 1), '^[^?#]*') as path, substr(rest0, length(host0) + 1) as tail from h),
p as (select page_id, host, path, substr(tail, length(path) + 1) as rest from a),
f as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(action, length(h || p)) as action from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p) group by page_id)
select p.page_id, host, path, f.rule, coalesce(f.action, case when host <> '' and ({general}) then 'block' else 'allow' end) as verdict
from p left join f on p.page_id = f.page_id
"""


OP7_SQL = _oracle()
