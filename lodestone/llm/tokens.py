"""Token counts that follow edits, by trees that are kept with the documents.

A text's pre-tokens stand in the leaves of a segment tree that sums characters and tokens. An edit descends by
characters to the leaves it touches, splits the text anew from a little before it, only until a boundary falls on one
of old (from there on the text is what it was), counts the new pre-tokens and updates the sums above. The rest of the text is
neither split nor encoded again.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import arrow_pass, list_array, pick, spread, table, with_row

RANKS = "byte_bpe_50k.tiktoken"
LEAF = 64
#: Characters that the split pattern may look at beyond a pre-token's end: one that ends it, and one more after white space or an apostrophe.
BEYOND = 2


@cache
def splitter() -> Callable:
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class Counts(dict):
    """Tokens of a pre-token, remembered up to a bound."""

    def __init__(self, name: str, most: int = 500_000):
        import public_tokenizers
        import tiktoken

        path = name if os.sep in name else public_tokenizers.path(name)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n


@cache
def counts(name: str) -> Counts:
    return Counts(name)


class TokenTree:
    """Nodes are numbered as in a heap: node k sums nodes 2k and 2k+1; leaf i is node size + i and holds pre-tokens with their tokens."""

    def __init__(self, text: str, count: Counts, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        """From a text; with the characters and tokens of its pre-tokens, as `stored` has them, nothing is split or counted."""
        self.count = count
        if chars is None:
            pieces = splitter().findall(text)
            each = list(map(count.__getitem__, pieces))
        else:
            ends = np.cumsum(chars).tolist()
            pieces, each = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)], tokens.tolist()
        self.build(pieces, each)

    def build(self, pieces: list[str], each: list[int]) -> None:
        cut = range(0, len(pieces), LEAF)
        self.leaves, self.each = [pieces[i : i + LEAF] for i in cut] or [[]], [each[i : i + LEAF] for i in cut] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if pieces:
            both = np.array([list(map(len, pieces)), each], np.int64)
            self.sums[self.size : self.size + len(self.leaves)] = np.add.reduceat(both, np.arange(0, len(pieces), LEAF), axis=1).T
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def stored(self) -> tuple[list[int], list[int]]:
        """The characters and the tokens of each pre-token: what the tree can be built from again."""
        return [len(p) for leaf in self.leaves for p in leaf], [n for leaf in self.each for n in leaf]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character, and where the leaf begins; beyond the end the last leaf with any."""
        place, k, begin = max(0, min(place, self.chars - 1)), 1, 0
        while k < self.size:
            k *= 2
            if place - begin >= (left := int(self.sums[k, 0])):
                begin += left
                k += 1
        return k - self.size, begin

    def update(self, leaf: int, pieces: list[str], each: list[int]) -> None:
        self.leaves[leaf], self.each[leaf] = pieces, each
        k = self.size + leaf
        change = np.array([sum(map(len, pieces)), sum(each)]) - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Characters start..end become new; returns how many characters were split and counted anew."""
        start = max(0, min(start, self.chars))
        end = max(start, min(end, self.chars))
        first, begin = self.leaf_at(start - BEYOND - 1)
        stays, at = 0, begin
        for p in self.leaves[first]:
            if at + len(p) + BEYOND > start:
                break
            stays += 1
            at += len(p)
        # Old pieces from `at` on, leaf by leaf as far as needed, and where they end.
        last, old, counts, stop = first, self.leaves[first][stays:], self.each[first][stays:], begin + sum(map(len, self.leaves[first]))

        def further(until: int) -> None:
            nonlocal last, stop
            while last + 1 < len(self.leaves) and stop < until:
                last += 1
                old.extend(self.leaves[last])
                counts.extend(self.each[last])
                stop += sum(map(len, self.leaves[last]))

        while True:
            further(end + BEYOND + 1)
            whole = last + 1 == len(self.leaves)
            text = "".join(old)
            text = text[: start - at] + new + text[end - at :]
            fresh = start - at + len(new)  # from here on the text is as before
            ends = np.cumsum([0, *map(len, old)]) - (end - start) + len(new)
            known = {int(e): i for i, e in enumerate(ends) if e >= fresh}
            pieces, here = [], 0
            for m in splitter().finditer(text):
                if here in known or (not whole and m.end() + BEYOND > len(text)):
                    break
                pieces.append(m[0])
                here = m.end()
            if here in known or here == len(text):
                break
            if whole:
                raise AssertionError("the pattern leaves no character out")
            further(stop + LEAF + 1)
        rest = known.get(here, len(old))
        merged = self.leaves[first][:stays] + pieces + old[rest:]
        each = self.each[first][:stays] + list(map(self.count.__getitem__, pieces)) + counts[rest:]
        if len(merged) > 4 * LEAF * (last - first + 1):
            flat = lambda parts: [x for part in parts for x in part]
            self.build(flat(self.leaves[:first]) + merged + flat(self.leaves[last + 1 :]), flat(self.each[:first]) + each + flat(self.each[last + 1 :]))
        else:
            share = -(-len(merged) // (last - first + 1)) or 1
            for i in range(first, last + 1):
                part = slice((i - first) * share, (i - first + 1) * share)
                self.update(i, merged[part], each[part])
        return here


EDITS = "array<struct<start:int,end:int,new:string>>"
TREE = (("piece_chars", T.ArrayType(T.IntegerType())), ("piece_tokens", T.ArrayType(T.IntegerType())))


def packed_lists(lists: Sequence[list[int]]) -> pa.ListArray:
    return list_array(np.array([len(x) for x in lists]), pa.array(np.concatenate([np.array(x, np.int32) for x in lists])))


#: Texts whose trees a task holds at once.
AT_ONCE = 200


def sliced(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    return lambda batch: (fn(batch.slice(i, AT_ONCE)) for i in range(0, batch.num_rows, AT_ONCE))


def after(tree: TokenTree, edits: list[dict] | None) -> tuple[int, int]:
    """Makes the edits; returns how many there are and how many characters were split and counted anew."""
    return len(edits or ()), sum(tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "") for e in edits or () if e)


def trees(rows: DataFrame, name: str = RANKS) -> DataFrame:
    """(row, text) -> (row, text, piece_chars, piece_tokens, n_chars, n_tokens): the tree of each text in a form that can be written, read and edited again. Null and empty texts have no pieces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        built = [TokenTree(t.as_py() or "", counts(name)) for t in batch.column(1)]
        chars, tokens = zip(*(t.stored() for t in built), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed_lists(chars), packed_lists(tokens), pa.array([t.chars for t in built], pa.int64()), pa.array([t.tokens for t in built], pa.int64())], ["row", "text", *(c for c, _ in TREE), "n_chars", "n_tokens"])

    return arrow_pass(rows.select("row", "text"), sliced(run), with_row(rows, ("text", T.StringType()), *TREE, ("n_chars", T.LongType()), ("n_tokens", T.LongType())))


def edited(kept: DataFrame, name: str = RANKS) -> DataFrame:
    """(row, text, piece_chars, piece_tokens, edits), trees that were kept -> the same of the edited texts, and n_chars, n_tokens, n_edits, n_recounted_chars.

    No text is split or counted but around its edits. Edits are made in order, each on what the ones before left; places beyond the text are taken as its end, a null
    `new` as empty, null edits as none. A null text becomes an empty one.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, chars, tokens, sums = [], [], [], []
        for i, edits in enumerate(batch.column(4).to_pylist()):
            tree = TokenTree(batch.column(1)[i].as_py() or "", counts(name), *(batch.column(k)[i].values.to_numpy() for k in (2, 3)))
            n, anew = after(tree, edits)
            a, b = tree.stored()
            texts.append(tree.text())
            chars.append(a)
            tokens.append(b)
            sums.append((tree.chars, tree.tokens, n, anew))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), packed_lists(chars), packed_lists(tokens), *[pa.array(x, pa.int64()) for x in zip(*sums, strict=True)]], ["row", "text", *(c for c, _ in TREE), *names])

    names = ["n_chars", "n_tokens", "n_edits", "n_recounted_chars"]
    rows = kept.select("row", "text", *(c for c, _ in TREE), F.col("edits").cast(EDITS))
    return arrow_pass(rows, sliced(run), with_row(rows, ("text", T.StringType()), *TREE, *((c, T.LongType()) for c in names)))


def counted(rows: DataFrame, name: str = RANKS) -> DataFrame:
    """(row, text, edits) -> (row, n_chars, n_tokens, n_edits, n_tokens_edited, n_recounted_chars): trees that are built, edited and let go. Rules as for `edited`."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, edits in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            tree = TokenTree(text.as_py() or "", counts(name))
            before = tree.chars, tree.tokens
            n, anew = after(tree, edits)
            out.append((*before, n, tree.tokens, anew))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in zip(*out, strict=True)]], ["row", *names])

    names = ["n_chars", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted_chars"]
    return arrow_pass(rows, sliced(run), with_row(rows, *[(c, T.LongType()) for c in names]))


def revised(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id and the counts before and after a revision of each text: a note put in after a quarter, twelve characters cut at the middle, five replaced at three quarters.

    A row for each row of docs; nothing is grouped, so repeated rows and null ids are counted each for itself; null and empty texts have no tokens before the
    note; very long texts are counted whole; other columns are ignored; no rows: no rows.
    """
    own = pick(docs, "doc_id", "text").select(F.struct("doc_id").alias("row"), F.col("text").cast("string").alias("text"))
    n = "coalesce(length(text), 0)"
    edits = F.expr(f"""array(struct(cast({n} div 4 as int) as start, cast({n} div 4 as int) as end, ' [editor''s note] ' as new),
        struct(cast({n} div 2 as int) as start, cast({n} div 2 + 12 as int) as end, '' as new),
        struct(cast({n} * 3L div 4 as int) as start, cast({n} * 3L div 4 + 5 as int) as end, 'reworded' as new))""")
    return counted(own.select("row", "text", edits.cast(EDITS).alias("edits")), name).select("row.doc_id", "n_chars", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted_chars")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revised(spread(table(spark, sf_dir, "documents")))
