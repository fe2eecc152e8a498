"""Quality rules, with repetition measured on suffix arrays.

The suffix arrays of all texts of a block are built at once, by doubling over word ranks that hold the text as well, so
no order or repeat crosses texts. Neighbours in the array give the longest common prefixes; runs of neighbours with a common prefix
are the intervals of maximal repeated substrings, and each suffix keeps the longest that it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import arrow_pass, packed, pick, spread, table, unpacked, with_row
from lodestone.llm.words import Block, blocks

LEAST_WORDS, REPEAT, MOST_REPEATED = 20, 8, 30
#: The suffix-array rule: most of the characters, in hundredths, that repeats of REPEAT words or more may cover, and the most words of a repeat.
MOST_COVERED, LONGEST = 30, 250
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat"]


def longest_repeats(words: np.ndarray, doc: np.ndarray, least: int = REPEAT, most: int = LONGEST + 1) -> np.ndarray:
    """For each word the length of the longest substring that starts there and occurs again in its text, if `least` words or more, else 0; `most` stands for any longer one.

    Suffixes are told apart up to the first power of two from `most` on, so as many levels of ranks are held as that power has bits, whatever the text.
    """
    n, out = len(words), np.zeros(len(words), np.int64)
    if not n:
        return out
    _, ids = np.unique(words, return_inverse=True)
    key = doc * (int(ids.max()) + 1) + ids
    order = np.argsort(key)
    key = key[order]
    active, head = ranked(key, order, np.zeros(n, np.int64))
    rank = np.empty(n, np.int32)
    rank[order] = head
    levels, h = [rank], 1
    # Ranks by the first h words. Only suffixes that share them with another are sorted on.
    while len(active) and h < most:
        after = active + h
        ok = after < n
        ok[ok] = doc[after[ok]] == doc[active[ok]]
        second = np.where(ok, rank[np.minimum(after, n - 1)] + 1, 0)
        base = rank[active].astype(np.int64)
        o = np.lexsort((second, base))
        active, base, second = active[o], base[o], second[o]
        rank = rank.copy()
        old = active
        active, head = ranked(base * (n + 1) + second, active, base)
        rank[old] = head
        levels.append(rank)
        h *= 2
    array = np.argsort(rank, kind="stable")
    a, b = array[:-1], array[1:]
    top = max(0, (least - 1).bit_length() - (least & (least - 1) != 0))
    if top >= len(levels):
        return out
    near = np.flatnonzero(levels[top][a] == levels[top][b])
    a, b, common = a[near], b[near], np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += (1 << k) * ((levels[k][x] == levels[k][y]) & (a + common < n) & (b + common < n) & (x != y))
    common[common < least] = 0
    np.minimum(common, most, out=common)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def ranked(key: np.ndarray, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the places whose key isn't unique, and the rank of each (base, and its group's first place among those of the base)."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    group = np.concatenate([[True], base[1:] != base[:-1]])
    start = np.maximum.accumulate(np.where(group, np.arange(len(key)), 0))
    alone = new & np.concatenate([new[1:], [True]])
    return at[~alone], base + first - start


def measures(b: Block) -> dict[str, np.ndarray]:
    """COUNTS for each text of the block."""
    texts = b.hi - b.lo
    doc = b.doc_of_word()
    char = (b.data & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(char)])
    chars = upto[b.end] - upto[b.start]

    def per_text(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[b.word_at[1:]] - total[b.word_at[:-1]]

    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[b.data])])
    repeat = longest_repeats(b.hashes(), doc)
    edge = np.zeros(len(repeat) + 1, np.int64)
    own = np.flatnonzero(repeat)
    np.add.at(edge, own, 1)
    np.add.at(edge, own + repeat[own], -1)
    covered = np.cumsum(edge[:-1]) > 0
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, doc, repeat)
    lines = np.zeros(texts, np.int64)
    for d in range(texts):
        own_lines = [x for x in b.text(d).split(b"\n") if x and not x.isspace()]
        lines[d] = len(own_lines) - len(set(own_lines))
    return dict(zip(COUNTS, [b.counts, per_text(chars), symbols[b.text_at[1:]] - symbols[b.text_at[:-1]], lines, per_text(covered), per_text(chars * covered), longest], strict=True))


def with_measures(rows: DataFrame) -> DataFrame:
    """(row, text, ...) -> (row, COUNTS): the counts of each text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [measures(b) for b in blocks(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate([m[c] for m in found]), pa.int64()) for c in COUNTS]], ["row", *COUNTS])

    return arrow_pass(rows, run, with_row(rows, *[(c, T.LongType()) for c in COUNTS]))


BASE_FAILED = f"(n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words)"
KEPT = f"(not {BASE_FAILED} and 100 * covered_chars <= {MOST_COVERED} * word_chars and longest_repeat <= {LONGEST})"


def judged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, COUNTS, base_failed, kept), a row for each row of docs. longest_repeat is LONGEST + 1 if a repeat is longer than LONGEST words.

    Null and empty texts have no words and fail. Nothing is grouped, so repeated rows and null ids are judged each for
    itself. Other columns are ignored. No rows: no rows.
    """
    own = pick(docs, "doc_id", "text")
    found = with_measures(own.select(F.struct("doc_id").alias("row"), F.col("text").cast("string").alias("text")))
    return found.select("row.doc_id", *COUNTS, F.expr(BASE_FAILED).alias("base_failed"), F.expr(KEPT).alias("kept"))


def good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep."""
    return unpacked(with_measures(packed(docs)).where(KEPT).select("row"), docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i+7], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from d where len(w) >= 8)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
c as (select distinct doc_id, p from (select doc_id, unnest(generate_series(i, i + 7)) as p from r)),
n as (select c.doc_id, count(*) as n, sum(len(d.w[c.p])) as chars from c join d on c.doc_id = d.doc_id group by c.doc_id),
l as (select distinct doc_id from (select doc_id, count(*) over (partition by doc_id, g) as c from (select doc_id, array_to_string(w[i:i+250], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 250)) as i from d where len(w) > 251 and doc_id in (select doc_id from r)))) where c > 1),
o as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) as word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d)
select o.doc_id, cast(o.n_words as bigint) as n_words, cast(o.word_chars as bigint) as word_chars, cast(o.n_symbols as bigint) as n_symbols, cast(len(o.lines) - len(list_distinct(o.lines)) as bigint) as n_dup_lines,
  cast(coalesce(n.n, 0) as bigint) as n_repeat_words, o.n_words < 20 or 100 * coalesce(n.n, 0) > 30 * o.n_words as base_failed,
  not (o.n_words < 20 or 100 * coalesce(n.n, 0) > 30 * o.n_words) and 100 * coalesce(n.chars, 0) <= 30 * o.word_chars and l.doc_id is null as kept
from o left join n on o.doc_id = n.doc_id left join l on o.doc_id = l.doc_id
"""
