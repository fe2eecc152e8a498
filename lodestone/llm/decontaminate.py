"""Benchmark decontamination by winnowing.

Of the k-gram hashes in each sliding window of a text the least is kept as its fingerprint, so a span that a document
shares with a test item yields the same fingerprint in both, whatever stands around it. Document fingerprints that may be test
fingerprints (a Bloom filter of fixed size over them all, which errs on one side only) are extended to the whole window,
and the windows are joined word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Scratch, arrow_pass, bloom, bloom_has, kind_of, list_array, packed, pick, spread, table, text_key, unpacked, with_row
from lodestone.llm.substring import union_pass
from lodestone.llm.words import LOWER, NOT_ALNUM, Block, blocks, sliding_argmin, windows

WINDOW = 10


def fingerprint(words: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of each window of `length` words: its least hash of half as many words."""
    k = (length + 1) // 2
    seeds = windows(words, k)
    return seeds[sliding_argmin(seeds, length - k + 1)].view(np.int64)


def window_text(b: Block, i: int, length: int) -> str:
    return b" ".join(b.data[s:e].tobytes() for s, e in zip(b.start[i : i + length].tolist(), b.end[i : i + length].tolist(), strict=True)).decode()


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, text) -> (item_id, body, len, print, words): a row for each window of an item; body tells items of other words apart."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in blocks(batch.column(1), NOT_ALNUM, lower=True):
            words, out = b.hashes(), []
            for d, n in enumerate(b.counts.tolist()):
                if n:
                    lo, length = int(b.word_at[d]), min(n, window)
                    body = text_key(window_text(b, lo, n).encode())
                    prints = fingerprint(words[lo : lo + n], length).tolist()
                    out += [(d, body, length, p, window_text(b, lo + i, length)) for i, p in enumerate(prints)]
            if out:
                at, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.hi - b.lo).take(pa.array(at)), *[pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)]], ["item_id", "body", "len", "print", "words"])

    return arrow_pass(items, run, "item_id string, body bigint, len int, print bigint, words string")


def candidates(docs: DataFrame, lengths: list[int], prints: np.ndarray) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_key, n_words, found): the windows whose fingerprint may be a test item's."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in blocks(batch.column(1), NOT_ALNUM, lower=True):
            words, doc = b.hashes(), b.doc_of_word()
            at, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for length in lengths:
                p = fingerprint(words, length)
                i = np.flatnonzero(bloom_has(prints, p))
                i = i[doc[i] == doc[i + length - 1]]
                at.append(i)
                of.append(np.full(len(i), length))
            at, of = np.concatenate(at), np.concatenate(of)
            order = np.argsort(at, kind="stable")
            at, of = at[order], of[order]
            found = pa.StructArray.from_arrays([pa.array((at - b.word_at[doc[at]]).astype(np.int32)), pa.array(of.astype(np.int32)), pa.array([window_text(b, i, n) for i, n in zip(at.tolist(), of.tolist(), strict=True)], pa.string())], ["start", "len", "words"])
            keys = pa.array([text_key(b.text(d)) for d in range(b.hi - b.lo)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.hi - b.lo), keys, pa.array(b.counts.astype(np.int64)), list_array(np.bincount(doc[at], minlength=b.hi - b.lo), found)], ["doc_id", "text_key", "n_words", "found"])

    return arrow_pass(docs, run, f"doc_id {kind_of(docs)}, text_key bigint, n_words bigint, found array<struct<start:int,len:int,words:string>>")


def overlaps(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, hits.

    A row for each row of docs. A window is `window` consecutive words of an item, or all words of a shorter item; hits
    are the maximal spans [start, end) of a document's words that windows cover. Null and empty texts have no words
    and no hits, items without words hit nothing. A null item_id hits words but isn't listed or counted; items repeated under one id
    count once. Rows that repeat a doc_id are told apart by their text. Other columns are ignored. No items: all clean.
    """
    scratch = Scratch(spark, "decontaminate")
    own = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string"))
    tests = scratch.write(item_windows(pick(items, "item_id", "text").select(F.col("item_id").cast("string"), F.col("text").cast("string")), window), "items")
    lengths = sorted(r.len for r in tests.select("len").distinct().collect())  # of 1 to `window`
    facts = scratch.write(candidates(own, lengths, bloom(tests, "print")), "facts")
    found = facts.select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*")
    hit = scratch.write(found.join(tests.select("words").distinct(), "words"), "hit")
    spans = hit.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("runs"))
    spans = union_pass(spans).withColumnRenamed("spans", "hits")
    # Items of the same words are one body until the end.
    bodies = hit.select("doc_id", "text_key", "words").distinct().join(tests.select("words", "body").distinct(), "words").select("doc_id", "text_key", "body").distinct()
    listed = bodies.join(tests.where("item_id is not null").select("body", "item_id").distinct(), "body")
    listed = listed.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = facts.select("doc_id", "text_key", "n_words").alias("d")
    for more in (spans, listed):
        more = more.withColumnsRenamed({"doc_id": "id_", "text_key": "key_"})
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left").drop("id_", "key_")
    n_hit = F.expr("cast(coalesce(aggregate(hits, 0L, (a, r) -> a + r.end - r.start), 0) as bigint)")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "hits",
    )


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that share no window with an item, with all their columns. Rows are told apart by their text; null texts share nothing."""
    scratch = Scratch(spark, "clean")
    bad = overlaps(spark, docs, items).where("contaminated").select("text_key").distinct()
    bad = scratch.write(bad, "bad")
    cols = docs.columns

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = [text_key((t.as_py() or "").encode().translate(LOWER.tobytes())) for t in batch.column(1)]  # as in candidates()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64())], ["row", "key"])

    rows = packed(docs)
    rows = arrow_pass(rows, keyed, with_row(rows, ("key", T.LongType())))
    return unpacked(rows.join(bad, F.col("key") == F.col("text_key"), "left_anti"), cols)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(spark, spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = r"""
with i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select item_id, least(len(w), 10) as n, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as s from i where len(w) > 0),
ig as (select distinct item_id, n, array_to_string(w[s:s+n-1], ' ') as g from iw),
ns as (select distinct n from ig),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dw as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d, ns where len(w) >= n),
dg as (select doc_id, n, s, array_to_string(w[s:s+n-1], ' ') as g from dw),
h as (select dg.doc_id, dg.s, dg.n, ig.item_id from dg join ig on dg.g = ig.g and dg.n = ig.n),
p as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(p.n_hit, 0) as bigint) as n_hit, cast(coalesce(t.n_items, 0) as bigint) as n_items, sha256(coalesce(t.ids, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from d left join p on d.doc_id = p.doc_id left join t on d.doc_id = t.doc_id
"""
