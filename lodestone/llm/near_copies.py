"""SimHash near copies by the similarity of their sets of five-word shingles.

At a similarity of 0.8 the fingerprints of two texts differ in about 10 of 64 bits, and no rule of equal blocks brings such
fingerprints together under a key that unrelated ones don't share. So they are routed by keys of three least hashes of their shingles, 16
of them: texts of that similarity miss each other with a probability of 0.00001, and more similar ones less. Under a
key, fingerprints stand in Gray order in the tree of `simhash`, which prunes groups that differ in too many bits; what it leaves is
compared by the sets themselves, so that links are exact. Texts with the same set are one node throughout.

Rounds take some of the keys each. What earlier links connect isn't compared again, so a later round sees only groups
that still fall apart, and only their sets are shuffled. Groups that hold the same nodes are one. A large group is dealt out as pairs of
parts, and a task yields a forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, arrow_pass, bloom, bloom_has, list_array, parted, pick
from lodestone.llm.components import contracted
from lodestone.llm.simhash import gray_rank, majority, near_pairs
from lodestone.llm.words import blocks, both, mix, span_hash

SHINGLE = 5
#: Similarity of near copies, as a fraction.
OVER, UNDER = 4, 5
#: Keys of a text, and least hashes in each. Keys of the rounds: those before the first number, and so on.
KEYS, LEAST = 16, 3
ROUNDS = (2, 6, KEYS)
#: Bits in which fingerprints of near copies may differ: five standard deviations over the mean at the similarity.
DIFFERING = 24
#: Most nodes, and shingles, of a part of a group that one task compares with another part.
PART_NODES, PART_SHINGLES = 2048, 1 << 20
_ODD = (np.random.RandomState(20240611).randint(1, 1 << 62, KEYS * LEAST).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For a block of texts after another: how many distinct shingles each has, and their hashes, sorted in each text. A text of fewer words is one shingle, one without words has none."""
    for b in blocks(texts, lower=True):
        n, first = b.counts, b.word_at[:-1]
        spans = np.where(n > 0, np.maximum(1, n - SHINGLE + 1), 0)
        doc = np.repeat(np.arange(len(n)), spans)
        lo = np.repeat(first, spans) + (np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans))
        h = span_hash(b.hashes(), lo, np.minimum(lo + SHINGLE, np.repeat(b.word_at[1:], spans)))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
        yield np.bincount(doc[new], minlength=len(n)), h[new]


def least_keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """KEYS keys for each text, a row a text."""
    full = np.flatnonzero(counts)
    at = np.cumsum(counts[full]) - counts[full]
    out = np.zeros((len(counts), KEYS), np.uint64)
    for k in range(KEYS):
        key = np.full(len(full), k + 1, np.uint64)
        for odd in _ODD[k * LEAST : (k + 1) * LEAST]:
            key = both(key, np.minimum.reduceat(h * odd, at)) if len(full) else key
        out[full, k] = key
    return out


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) -> doc_id, text_key, node (of the set), n (shingles), fp, keys."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for counts, h in shingle_sets(batch.column(2)):
            ends = np.cumsum(counts)
            node = [xxhash.xxh3_64_intdigest(h[e - c : e].tobytes()) - (1 << 63) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            fp = majority(lambda part: mix(h[part]), counts)  # noqa: B023
            keys = list_array(np.full(len(counts), KEYS), pa.array(least_keys(h, counts).view(np.int64).ravel()))
            own = [batch.column(i).slice(at, len(counts)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(node, pa.int64()), pa.array(counts, pa.int64()), pa.array(fp.view(np.int64)), keys], ["doc_id", "text_key", "node", "n", "fp", "keys"])
            at += len(counts)

    return arrow_pass(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, node bigint, n bigint, fp bigint, keys array<bigint>")


def sets_of(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(row_key, text) -> (row_key, shingles) of the rows that the filter may want, repeated ones once a batch."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column(0).to_numpy()
        own = np.flatnonzero(bloom_has(wanted, keys))
        own = own[np.unique(keys[own], return_index=True)[1]]
        if len(own):
            some, at = batch.column(1).take(pa.array(own)), 0
            for counts, h in shingle_sets(some):
                yield pa.RecordBatch.from_arrays([pa.array(keys[own[at : at + len(counts)]]), list_array(counts, pa.array(h.view(np.int64)))], ["row_key", "shingles"])
                at += len(counts)

    return arrow_pass(texts, run, "row_key bigint, shingles array<bigint>").dropDuplicates(["row_key"])


def joined(node: np.ndarray, root: np.ndarray, fp: np.ndarray, counts: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect whatever near copies the nodes of one group hold and earlier links (root) don't."""
    order = np.argsort(gray_rank(fp))
    at = (np.cumsum(counts) - counts)[order]
    counts, node, fp = counts[order], node[order], fp[order]
    x, y = near_pairs(fp, np.zeros(len(fp), np.int64), DIFFERING)
    near = np.minimum(counts[x], counts[y]) * UNDER >= np.maximum(counts[x], counts[y]) * OVER
    _, label = np.unique(root[order], return_inverse=True)
    x, y = x[near], y[near]
    by = np.argsort(x, kind="stable")
    x, y = x[by], y[by]
    _, code = np.unique(h, return_inverse=True)
    has = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    first = np.searchsorted(x, np.arange(len(node) + 1))
    for i in range(len(node)):
        j = y[first[i] : first[i + 1]]
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        own = code[at[i] : at[i] + counts[i]]
        has[own] = True
        size = counts[j]
        # All shingles of the partners in a row, and how many of each partner's the node has too.
        of = np.repeat(at[j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        same = np.add.reduceat(has[code[of]].astype(np.int64), np.cumsum(size) - size)
        has[own] = False
        for k in j[same * UNDER >= (size + counts[i] - same) * OVER].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                yield int(node[i]), int(node[k])


def links_pass(members: DataFrame) -> DataFrame:
    """(key, node, root, fp, shingles), whole groups sorted by key in a partition -> links (u, v)."""

    def group(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        key, node, root, fp = (table.column(c).to_numpy() for c in ("key", "node", "root", "fp"))
        lists = table.column("shingles").combine_chunks()
        counts, h = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield from joined(node[a:b], root[a:b], fp[a:b].view(np.uint64), counts[a:b].astype(np.int64), h[upto[a] : upto[b]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = list(group(parts))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        held: list[pa.RecordBatch] = []  # the last group of a batch waits for the next one
        for batch in batches:
            if batch.num_rows:
                cut = int(np.searchsorted(batch.column(0).to_numpy(), batch.column(0)[-1].as_py()))
                if cut or (held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py()):
                    yield from linked([*held, *([batch.slice(0, cut)] if cut else [])])
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield from linked(held)

    return members.mapInArrow(run, "u bigint, v bigint")


def row_key() -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64("doc_id", "text_key").alias("row_key")


def groups(nodes: DataFrame, lo: int, hi: int) -> DataFrame:
    """(key, node, text_key, root, fp): what meets under the keys lo..hi and isn't connected yet, in parts that a task can hold."""
    live = nodes.where("n > 0").select("node", "row_key", "root", "fp", "n", F.explode(F.slice("keys", lo + 1, hi - lo)).alias("key"))
    some = live.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("a"), F.max("root").alias("b"), F.sum("n").alias("size"), F.expr("bit_xor(xxhash64(node))").alias("who"))
    some = some.where("a <> b").groupBy("who", "m", "size").agg(F.min("key").alias("key"))  # groups of the same nodes are one
    parts = F.ceil(F.greatest(F.col("m") / PART_NODES, F.col("size") / PART_SHINGLES)).cast("int")
    met = live.join(some.select("key", parts.alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = "if(parts = 1, array(key), transform(sequence(0, parts - 1), j -> xxhash64(key, least(own, j), greatest(own, j))))"
    return met.select(F.explode(F.expr(dealt)).alias("key"), "node", "row_key", "root", "fp", "n")


def components(texts: DataFrame, facts: DataFrame, scratch: Scratch, last: Scratch) -> DataFrame:
    """(node, root) of the nodes that have a near copy; texts (row_key, text), of which one row stands for each node."""
    one = F.min(F.struct(row_key(), "n", "fp", "keys"))
    nodes = facts.groupBy("node").agg(one.alias("x")).select("node", "x.*")
    nodes = scratch.write(nodes, "nodes")
    roots, links = None, None
    for k, (lo, hi) in enumerate(zip((0, *ROUNDS), ROUNDS, strict=False)):
        rooted = nodes.withColumn("root", F.col("node")) if roots is None else nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        members = scratch.write(groups(rooted, lo, hi), f"members{k}")
        rows, shingles = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not rows:
            continue
        sets = sets_of(texts, bloom(members, "row_key"))
        tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingles * 8 >> 25)
        met = members.drop("n").join(sets, "row_key").select("key", "node", "root", "fp", "shingles")
        found = links_pass(met.repartition(tasks, "key").sortWithinPartitions("key"))
        new = scratch.write(found.distinct(), f"links{k}")
        scratch.drop(f"members{k}")
        links = new if links is None else links.unionByName(new)
        roots = contracted(links, last)
        if hi < ROUNDS[-1]:
            roots = scratch.write(roots, f"roots{k}")
            last.keep_only()
    if roots is None:
        return nodes.select("node", F.col("node").alias("root"))
    return roots


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that with the least doc_id; the columns of docs.

    Near copies are texts whose sets of five-word shingles, A-Z lower-cased, reach a Jaccard similarity of 0.8, and groups are what they connect. Null, empty and blank
    texts have no shingles and are copies of one another. Rows without an id connect others and stay. Rows that repeat a doc_id are
    told apart by their text; of several in one group, or of equal ones, one stays. Very long texts are compared whole.
    Other columns may have any names. No rows: no rows.
    """
    scratch, last = Scratch(spark, "near-copies"), Scratch(spark, "near-copies-components")
    own = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    facts = scratch.write(described(own.select("doc_id", "text_key", "text")), "facts")
    roots = components(own.select(row_key(), "text"), facts, scratch, last)
    rows = facts.select("doc_id", "text_key", "node").join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))
    rows = scratch.write(rows.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("times")), "rows")
    least = scratch.write(rows.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("least")), "least")  # written, so that the rows of a large group can be split in the join
    judged = rows.where("doc_id is not null").join(least, "root").withColumn("other", F.struct("doc_id", "text_key") != F.col("least")).where("other or times > 1")
    judged = scratch.write(judged.select(F.col("doc_id").alias("gone"), F.col("text_key").alias("gone_key"), "other"), "gone")
    scratch.keep_only("gone")
    last.keep_only()
    cols = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    doc_id, text = (F.col(f"c{cols.index(name) if name in cols else [c.lower() for c in cols].index(name)}") for name in ("doc_id", "text"))
    key = F.xxhash64(text.cast("string"))
    judged = judged.withColumn("key", F.xxhash64("gone", "gone_key"))
    may, stay = parted(flat, F.xxhash64(doc_id, key), judged)
    same = (F.col("key_") == F.col("key")) & (doc_id == F.col("gone")) & (key == F.col("gone_key"))
    out = stay.unionByName(may.join(judged, same, "left_anti").drop("key_"))
    twice = judged.where("not other")
    if not twice.isEmpty():
        one = may.join(twice, same, "left_semi").drop("key_")
        out = out.unionByName(one.dropDuplicates([f"c{i}" for i, c in enumerate(cols) if c.lower() in ("doc_id", "text")]))
    return out.toDF(*cols)
