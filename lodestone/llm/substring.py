"""Substring dedup: seeds on winnowed anchors, extended both ways, maximal repeats of `WINDOW` words or more removed.

Winnowing gives each window of 50 words one anchor, an 8-word seed at the same place in every text that has that
window. The windows of one anchor are a run, so an occurrence of a seed is extended left and right just as far as its
windows reach, and is described by a hash of that extent. Occurrences that agree in seed and extent are a class: all
their windows are the same, and the least doc_id of the class settles them at once. Seeds with more than one extent
(where a repeat begins or ends) are settled window by window, among the classes of the seed. No pairs of
documents are made: a passage in a million documents costs a million rows, aggregated before each shuffle. Windows
that are settled as repeats are put together again as maximal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Scratch, arrow_pass, bloom, bloom_has, kind_of, list_array, pick, spread, table, text_key, with_row
from lodestone.llm.words import Block, blocks, mix, sliding_argmin, span_hash, windows

WINDOW, SEED = 50, 8
#: seed: hash of the anchor's words; left: words from the first window's start to the anchor; n: windows; extent: hash of all words from the first window's start to the last one's end; at: the first window's start.
OCCURRENCE = "array<struct<seed:bigint,left:int,n:int,extent:bigint,at:int>>"
CLASS = ["seed", "left", "n", "extent"]


def occurrences(b: Block, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """The anchors of a block: text, seed hash, left, n, extent hash, first window's start (in its text), and the word hashes."""
    words = b.hashes()
    seeds = windows(words, seed)
    at = sliding_argmin(seeds, window - seed + 1)
    doc = b.doc_of_word()
    start = np.arange(len(at))
    inside = doc[: len(at)] == doc[window - 1 : window - 1 + len(at)]
    at, start = at[inside], start[inside]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([first, [len(at)]]))
    lo, at = start[first], at[first]
    extent = span_hash(words, lo, lo + n + window - 1)
    return doc[lo] if len(lo) else lo, seeds[at].view(np.int64), at - lo, n, extent.view(np.int64), lo - b.word_at[doc[lo]] if len(lo) else lo, words


def seeds_pass(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, text) -> doc_id, text_key, n_words, sha256 of the words joined, found (the occurrences)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in blocks(batch.column(1)):
            doc, s, left, n, extent, at, _ = occurrences(b, window, seed)
            keys, shas = [], []
            for d in range(b.hi - b.lo):
                text = b.text(d)
                keys.append(text_key(text))
                shas.append(hashlib.sha256(b" ".join(text.split())).hexdigest())  # bytes split at the same six bytes
            found = pa.StructArray.from_arrays([pa.array(s), pa.array(left.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(extent), pa.array(at.astype(np.int32))], ["seed", "left", "n", "extent", "at"])
            found = list_array(np.bincount(doc, minlength=b.hi - b.lo), found)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(keys, pa.int64()), pa.array(b.counts.astype(np.int64)), pa.array(shas, pa.string()), found], ["doc_id", "text_key", "n_words", "sha", "found"])

    return arrow_pass(docs, run, f"doc_id {kind_of(docs)}, text_key bigint, n_words bigint, sha string, found {OCCURRENCE}")


def split(b: Block, d: int) -> list[bytes]:
    lo, hi = b.word_at[d], b.word_at[d + 1]
    return [b.data[s:e].tobytes() for s, e in zip(b.start[lo:hi], b.end[lo:hi], strict=True)]


def windows_pass(docs: DataFrame, open_seeds: np.ndarray, window: int, seed: int) -> DataFrame:
    """(doc_id, text) -> the class key, doc_id and hashes of the windows (with their place relative to the seed) of each occurrence whose seed may be open. The filter errs on one side only; more rows do no harm."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in blocks(batch.column(1)):
            doc, s, left, n, extent, at, words = occurrences(b, window, seed)
            own = np.flatnonzero(bloom_has(open_seeds, s))
            if not len(own):
                continue
            n_own, first = n[own], at[own] + b.word_at[doc[own]]
            k = np.arange(n_own.sum()) - np.repeat(np.cumsum(n_own) - n_own, n_own)
            offset = (k - np.repeat(left[own], n_own)).astype(np.uint64)
            hashes = mix(windows(words, window)[np.repeat(first, n_own) + k] + offset * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            ids = batch.column(0).slice(b.lo, b.hi - b.lo).take(pa.array(doc[own]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(s[own]), pa.array(left[own].astype(np.int32)), pa.array(n_own.astype(np.int32)), pa.array(extent[own]), list_array(n_own, pa.array(hashes))], ["doc_id", *CLASS, "hashes"])

    return arrow_pass(docs, run, f"doc_id {kind_of(docs)}, seed bigint, left int, n int, extent bigint, hashes array<bigint>")


def shared_pass(wide: DataFrame, shared: np.ndarray) -> DataFrame:
    """The windows of the classes that other classes may have too: the class key, owner, k (its place in the class), hash."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(batch.num_columns - 1)
        of, each = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        own = np.flatnonzero(bloom_has(shared, each.to_numpy()))
        if len(own):
            k = (own - np.searchsorted(of, of[own])).astype(np.int32)
            rows = pa.array(of[own])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(len(CLASS) + 1)], pa.array(k), each.take(pa.array(own))], [*CLASS, "owner", "k", "hash"])

    return arrow_pass(wide.select(*CLASS, "owner", "hashes"), run, f"seed bigint, left int, n int, extent bigint, owner {kind_of(wide, 'owner')}, k int, hash bigint")


def settled_pass(facts: DataFrame, settled: np.ndarray) -> DataFrame:
    """The occurrences of facts whose class may be settled, so that the others aren't shuffled: doc_id, text_key, the class key, at."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = batch.column(2)
        doc, each = pc.list_parent_indices(found), found.flatten()
        own = pa.array(np.flatnonzero(bloom_has(settled, each.field("extent").to_numpy())))
        if len(own):
            doc, each = doc.take(own), each.take(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), *[each.field(c) for c in (*CLASS, "at")]], ["doc_id", "text_key", *CLASS, "at"])

    known = facts.where("doc_id is not null").select("doc_id", "text_key", "found")
    return arrow_pass(known, run, f"doc_id {kind_of(known)}, text_key bigint, seed bigint, left int, n int, extent bigint, at int")


def repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> facts (doc_id, text_key, n_words, sha) of every row, and spans: (doc_id, text_key, spans), the maximal spans of words [start, end) that smaller doc_ids have too, for the texts with any."""
    scratch = Scratch(spark, "substring")
    facts = scratch.write(seeds_pass(docs, window, seed), "facts")
    found = facts.where("doc_id is not null").select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*")
    classes = scratch.write(found.groupBy(*CLASS).agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("members")), "classes")
    several = scratch.write(classes.groupBy("seed").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("seed"), "several")
    # Classes of open seeds, with their windows: one row a class, as all members have the same.
    wide = windows_pass(docs.where("doc_id is not null"), bloom(several, "seed"), window, seed)
    wide = scratch.write(wide.groupBy(*CLASS).agg(F.min("doc_id").alias("owner"), F.first("hashes").alias("hashes")), "wide")
    each = wide.select("seed", "owner", F.explode("hashes").alias("hash"))
    least = each.groupBy("seed", "hash").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").drop("most")
    least = scratch.write(least, "least")
    taken = shared_pass(wide, bloom(least, "hash")).join(least, ["seed", "hash"]).where("least < owner").groupBy(*CLASS).agg(F.collect_set("k").alias("taken"))
    # What is settled: the owner of a class with members, and the windows its owner has from elsewhere.
    settled = classes.where("members > 1").select(*CLASS, "owner").join(taken, CLASS, "full")
    settled = scratch.write(settled, "settled")
    scratch.keep_only("facts", "settled")
    hit = settled_pass(facts, bloom(settled, "extent")).join(settled, CLASS).withColumn("whole", F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))).where("whole or taken is not null")
    runs = hit.select(
        "doc_id", "text_key",
        F.explode(F.when(F.col("whole"), F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + window).alias("end"))))
                  .otherwise(F.transform("taken", lambda k: F.struct((F.col("at") + k).alias("start"), (F.col("at") + k + window).alias("end"))))).alias("r"),
    )
    spans = runs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("r")).alias("runs"))
    spans = scratch.write(union_pass(spans), "spans")
    scratch.keep_only("facts", "spans")
    return facts.drop("found"), spans


def union_pass(runs: DataFrame) -> DataFrame:
    """(doc_id, text_key, runs) -> (doc_id, text_key, spans): the maximal spans that the sorted runs of a row cover, in time proportional to the runs."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        each, of = batch.column(2).flatten(), pc.list_parent_indices(batch.column(2)).to_numpy()
        above = of.astype(np.int64) << 32  # lifts the runs of a row over those of the rows before
        start, reach = each.field("start").to_numpy() + above, np.maximum.accumulate(each.field("end").to_numpy() + above)
        first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])[: len(of)])
        last = np.concatenate([first[1:], [len(of)]])[: len(first)] - 1
        spans = pa.StructArray.from_arrays([pa.array((x[i] - above[i]).astype(np.int32)) for x, i in ((start, first), (reach, last))], ["start", "end"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(np.bincount(of[first], minlength=batch.num_rows), spans)], ["doc_id", "text_key", "spans"])

    return arrow_pass(runs.select("doc_id", "text_key", "runs"), run, f"doc_id {kind_of(runs)}, text_key bigint, spans array<struct<start:int,end:int>>")


def cut_pass(texts: DataFrame) -> DataFrame:
    """(row, text, spans) -> (row, n_removed, kept): kept is the words left, joined by one space."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = batch.column(2).to_pylist()
        for b in blocks(batch.column(1)):
            removed, kept = [], []
            for d in range(b.hi - b.lo):
                words, out, last = split(b, d), [], 0
                for s in spans[b.lo + d] or ():
                    out += words[last : s["start"]]
                    last = s["end"]
                out += words[last:]
                removed.append(len(words) - len(out))
                kept.append(b" ".join(out).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_removed", "kept"])

    return arrow_pass(texts, run, with_row(texts, ("n_removed", T.LongType()), ("kept", T.StringType())))


def keyed_pass(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_key, text) of the rows that the filter may want."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).fill_null("")
        keys = np.array([text_key(t.as_buffer().to_pybytes() if t.as_buffer() else b"") for t in texts], np.int64)
        own = pa.array(np.flatnonzero(bloom_has(wanted, keys)))
        if len(own):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array(keys).take(own), texts.take(own)], ["doc_id", "text_key", "text"])

    return arrow_pass(docs, run, f"doc_id {kind_of(docs)}, text_key bigint, text string")


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256), a row for each row of docs.

    Words are removed where a window of 50 words that covers them also starts in a document with a smaller doc_id.
    Null and empty texts have no words; texts under 50 words lose none. A null doc_id neither owns nor loses words.
    Rows that share a doc_id don't take words from each other; repeated rows give repeated results. Other columns are ignored.
    """
    own = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string"))
    facts, spans = repeats(spark, own)
    texts = keyed_pass(own.where("doc_id is not null"), bloom(spans, "text_key")).join(spans, ["doc_id", "text_key"])
    cut = cut_pass(texts.select(F.struct("doc_id", "text_key").alias("row"), "text", "spans"))
    cut = cut.groupBy("row.doc_id", "row.text_key").agg(F.first("n_removed").alias("n_removed"), F.first(F.sha2("kept", 256)).alias("kept_sha"))
    cut = Scratch(spark, "cut").write(cut, "cut")
    return facts.join(cut, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256")
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark, spread(table(spark, sf_dir, "documents")))


OP4_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(generate_series(1, len(w) - 49)) as i, w from d where len(w) >= 50),
g as (select doc_id, i, array_to_string(w[i:i+49], ' ') as g from p),
o as (select doc_id, i, min(doc_id) over (partition by g) as o from g),
h as (select doc_id, list(i) as hit from o where o < doc_id group by doc_id),
c as (select doc_id, list_distinct(flatten(list_transform(hit, lambda i: generate_series(i, i + 49)))) as gone from h),
k as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as i from d),
g1 as (select doc_id, unnest(gone) as i from c),
j as (select k.doc_id, string_agg(k.word, ' ' order by k.i) as kept, count(*) as n from k anti join g1 on k.doc_id = g1.doc_id and k.i = g1.i group by k.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(j.n, 0) as bigint) as n_removed, sha256(coalesce(j.kept, '')) as kept_sha256
from d left join j on d.doc_id = j.doc_id
"""
