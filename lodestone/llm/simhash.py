"""SimHash near-duplicates: fingerprints, and their links by a Gray-order hierarchical index.

Fingerprints are routed by a pigeonhole rule: of `blocks` blocks of the 64 bits, any two fingerprints that differ in
3 bits or fewer agree on blocks - 3 at least, so each set of blocks - 3 blocks makes a key, and linked fingerprints meet
under one of the keys. Under a key they are sorted by Gray rank and indexed as a tree: a node holds the mask of
the bits that all of its fingerprints share, and those bits. Two nodes whose shared bits already differ in over 3 places
are pruned with everything below. What is left is compared bit by bit, so links are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Scratch, arrow_pass, pick, spread, table, with_row
from lodestone.llm.components import contracted
from lodestone.llm.words import blocks

DIFFERING, SHINGLE, SEED = 3, 3, 42
#: Fingerprints that one task compares under one key; a larger group is dealt out as pairs of parts.
GROUP = 2048
FANOUT = 16
#: Fingerprints, each under one key, that a task of the search gets at the mean.
RUN = 1 << 21


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    out, digest = np.zeros(len(texts), np.uint64), xxhash.xxh64_intdigest
    for b in blocks(texts, lower=True):
        inside = np.zeros(len(b.data) + 1, np.int8)
        inside[b.start] = 1
        inside[b.end] -= 1
        keep = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        size = b.end - b.start
        at = np.concatenate([[0], np.cumsum(size + 1)])
        joined = np.full(at[-1], 0x20, np.uint8)
        mask = np.ones(at[-1], bool)
        mask[at[1:] - 1] = False
        joined[mask] = b.data[keep]
        n, first = b.counts, b.word_at[:-1]
        spans = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
        lo = np.repeat(first, spans) + (np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans))
        hi = np.minimum(lo + shingle, np.repeat(b.word_at[1:], spans))
        whole = joined.tobytes()
        starts, ends = at[lo], at[hi] - 1
        out[b.lo : b.hi] = majority(lambda part: np.array([digest(whole[s:e], SEED) for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], np.uint64), spans)  # noqa: B023
    return out


def majority(hashes: Callable[[slice], np.ndarray], counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its shingles' hashes, counts[d] of them for text d: bits that are set in over half of them."""
    out, full = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    upto = np.concatenate([[0], np.cumsum(counts[full])])
    ones = np.zeros((len(full), 64), np.int64)
    step = 1 << 16
    for i in range(0, int(upto[-1]), step):  # bits of so many shingles at once: memory doesn't grow with the text
        h = hashes(slice(i, i + step))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        j0, j1 = np.searchsorted(upto, i, "right") - 1, np.searchsorted(upto, i + len(h), "left")
        cut = np.maximum(upto[j0:j1] - i, 0)
        ones[j0:j1] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    over = ones * 2 > counts[full][:, None]
    out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(packed: DataFrame) -> DataFrame:
    """(row, text) -> (row, fp bigint): the same 64 bits, signed."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], ["row", "fp"])

    return arrow_pass(packed, run, with_row(packed, ("fp", T.LongType())))


def gray_rank(v: np.ndarray) -> np.ndarray:
    """The place of v in the Gray sequence: neighbours in rank share long runs of bits."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


def near_pairs(values: np.ndarray, group: np.ndarray, differing: int = DIFFERING) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of values under one group that differ in `differing` bits or fewer.

    values must be sorted by group and Gray rank. The tree is descended for all groups at once, level by level.
    """
    empty = np.zeros(0, np.int64)
    if len(values) < 2:
        return empty, empty
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [len(values)]]))
    # Levels from the leaves up: for each node the places of its children one level below, its mask and its bits.
    levels = [(np.arange(len(values)), np.arange(1, len(values) + 1), np.full(len(values), ~np.uint64(0)), values)]
    lo, n = first, size
    while True:
        m = -(-n // FANOUT)
        node_first = np.cumsum(m) - m
        k = np.arange(m.sum()) - np.repeat(node_first, m)
        a = np.repeat(lo, m) + k * FANOUT
        b = np.minimum(a + FANOUT, np.repeat(lo + n, m))
        _, _, mask, bits = levels[-1]
        ones, zeros = np.bitwise_and.reduceat(bits & mask, a), np.bitwise_and.reduceat(~bits & mask, a)
        levels.append((a, b, ones | zeros, ones))
        lo, n = node_first, m
        if m.max() <= 1:
            break
    x = y = np.arange(len(levels[-1][0]))
    for depth in range(len(levels) - 1, 0, -1):
        a, b, _, _ = levels[depth]
        _, _, mask, bits = levels[depth - 1]
        nx, ny = b[x] - a[x], b[y] - a[y]
        pairs = nx * ny
        out_x, out_y = [], []
        step = 1 << 21
        cuts = np.searchsorted(np.cumsum(pairs), np.arange(step, pairs.sum() + step, step))
        for i, j in zip(np.concatenate([[0], cuts[:-1] + 1]), np.minimum(cuts + 1, len(pairs)), strict=True):  # a bounded number at once
            if i >= j:
                continue
            p = pairs[i:j]
            at = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            w = np.repeat(ny[i:j], p)
            cx, cy = np.repeat(a[x[i:j]], p) + at // w, np.repeat(a[y[i:j]], p) + at % w
            ok = cx < cy if depth == 1 else cx <= cy
            cx, cy = cx[ok], cy[ok]
            ok = np.bitwise_count((bits[cx] ^ bits[cy]) & mask[cx] & mask[cy]) <= differing
            out_x.append(cx[ok])
            out_y.append(cy[ok])
        x, y = (np.concatenate(z) if z else empty for z in (out_x, out_y))
    return x, y


def group_links(batch: pd.DataFrame) -> pd.DataFrame:
    """Links that join up what is near under each key: a spanning forest, at most one link a fingerprint."""
    v = batch["fp"].to_numpy(np.int64).view(np.uint64)
    rank = gray_rank(v)
    key = batch["key"].to_numpy(np.int64)
    order = np.lexsort((rank, key))
    v, key = v[order], key[order]
    x, y = near_pairs(v, key)
    root = np.arange(len(v))
    while True:  # least labels along the links until nothing changes, with jumps
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(v))
    return pd.DataFrame({"u": v[own].view(np.int64), "v": v[root[own]].view(np.int64)})


def blocks_for(n: int) -> int:
    """The fewest blocks whose keys leave about 64 random fingerprints under a key. Any number gives the same links."""
    return next((b for b in (4, 5, 6) if n < 64 << (64 * (b - DIFFERING) // b)), 7)


def keys(blocks_: int) -> list[int]:
    """A mask for each set of blocks_ - 3 blocks."""
    cuts = [64 * i // blocks_ for i in range(blocks_ + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks_ - DIFFERING)]


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect exactly what links of up to 3 differing bits connect."""
    masks = keys(blocks_for(fps.count()))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("bigint").bitwiseAND(F.col("fp")) for m in signed])).alias("mask", "part"))
    keyed = scratch.write(keyed.select("fp", F.xxhash64("mask", "part").alias("key")), "keyed")
    # Groups over GROUP are cut into parts, and each pair of parts is compared by a task of its own.
    large = keyed.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / GROUP).cast("int").alias("parts"))
    dealt = keyed.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    dealt = dealt.select(
        "fp",
        F.explode(F.expr("if(parts is null, array(key), transform(sequence(0, parts - 1), j -> xxhash64(key, least(own, j), greatest(own, j))))")).alias("key"),
    )
    # Many groups share a task's batch; a group is never cut, as the rows of a key go to one partition, sorted by it.
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), keyed.count() // RUN)
    dealt = dealt.repartition(n, "key").sortWithinPartitions("key")
    found = dealt.mapInPandas(whole_groups, "u bigint, v bigint")
    return scratch.write(found.distinct(), "links")


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of whole groups: the last group of a batch waits for the next one."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = int(np.searchsorted(batch["key"].to_numpy(), batch["key"].iloc[-1]))
        if cut == 0 and rest and rest[-1]["key"].iloc[-1] == batch["key"].iloc[-1]:
            rest.append(batch)
            continue
        yield group_links(pd.concat([*rest, batch.iloc[:cut]], ignore_index=True))
        rest = [batch.iloc[cut:]]
    if rest:
        yield group_links(pd.concat(rest, ignore_index=True))


def classes(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """ids (doc_id, fp) -> (fp, component_id), a row for each distinct fingerprint."""
    scratch = Scratch(spark, "simhash")
    least = scratch.write(ids.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    roots = contracted(links(least.select("fp"), scratch), scratch)
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = scratch.write(rooted.join(of_root, "root").select("fp", "component_id"), "classes")
    scratch.keep_only("classes")
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fingerprint, component_id), a row for each row of docs.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. A null doc_id links
    others but names no component; a component without any id is null. Repeated rows give repeated results. Other
    columns are ignored, whatever their names. No rows: no rows.
    """
    own = pick(docs, "doc_id", "text")
    ids = with_fingerprint(own.select(F.struct("doc_id").alias("row"), F.col("text").cast("string").alias("text"))).select("row.doc_id", "fp")
    ids = Scratch(spark, "fingerprints").write(ids, "ids")
    return ids.join(classes(spark, ids), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spread(table(spark, sf_dir, "documents")))
