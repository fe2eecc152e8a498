import numpy as np
import pyarrow as pa
import samples
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import components
from lodestone.llm import simhash as sh
from lodestone.llm.common import Scratch
from lodestone.llm.components import connected_components


def plain_print(text):
    w = samples.split(samples.low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(rows):
    """rows of (id, print) -> component of each row: the least id reachable, null if there is none."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    ids = {}
    for i, p in rows:
        if i is not None:
            ids[find(p)] = min(ids.get(find(p), i), i)
    return [ids.get(find(p)) for _, p in rows]


def test_whole_operator_against_brute_force(spark):
    rows = [(i, t) for i, t in samples.texts() if t is None or len(t) < 100_000]
    prints = [plain_print(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_components([(i, p) for (i, _), p in zip(rows, prints, strict=True)]), strict=True)), key=repr)
    assert samples.got(sh.near_duplicates(spark, samples.frame(spark, rows)), "doc_id", "fingerprint", "component_id") == want


def test_very_long_texts_and_steps():
    text = " ".join(samples.words(5, 70_000, 50_000))
    got = sh.fingerprints(pa.array(["a b c d", text, None, "", "x"]))
    assert got.tolist() == [plain_print(t) for t in ("a b c d", text, None, "", "x")]


def test_no_rows(spark):
    assert sh.near_duplicates(spark, samples.frame(spark, [])).collect() == []
    assert sh.near_duplicates(spark, samples.frame(spark, [(None, None)])).collect()[0][:] == (None, "0" * 16, None)


def clusters(n, flips, seed):
    rnd = np.random.RandomState(seed)
    centre = rnd.randint(0, 1 << 62, max(1, n // 20)).astype(np.uint64)
    out = np.repeat(centre, 20)[:n]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << rnd.randint(0, 64, len(out)).astype(np.uint64))
    return np.unique(out)


def test_tree_finds_every_pair():
    for n, flips in ((2, 1), (40, 2), (900, 3), (2000, 5)):
        v = clusters(n, flips, n)
        group = np.sort(np.random.RandomState(0).randint(0, 3, len(v)))
        order = np.lexsort((sh.gray_rank(v), group))
        v = v[order]
        x, y = sh.near_pairs(v, group)
        found = set(zip(x.tolist(), y.tolist(), strict=True))
        assert len(found) == len(x)
        want = {(i, j) for i in range(len(v)) for j in (np.flatnonzero((np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3) & (group[i + 1 :] == group[i])) + i + 1).tolist()}
        assert found == want


def test_keys_meet_whatever_bits_differ():
    rnd = np.random.RandomState(3)
    for blocks in (4, 5, 6, 7):
        masks = sh.keys(blocks)
        assert all(m.bit_count() >= 64 * (blocks - 3) // blocks - 3 for m in masks)
        for _ in range(300):
            diff = sum(1 << int(b) for b in rnd.choice(64, 3, replace=False))
            assert any(diff & m == 0 for m in masks)


def test_large_groups_are_cut_and_nothing_is_lost(spark, monkeypatch):
    v = clusters(600, 3, 8)
    want = plain_components([(i, int(p)) for i, p in enumerate(v)])
    ids = spark.createDataFrame([(i, int(p)) for i, p in enumerate(v.view(np.int64))], "doc_id long, fp long")
    monkeypatch.setattr(sh, "GROUP", 7)
    for blocks in (4, 5):
        monkeypatch.setattr(sh, "blocks_for", lambda n, b=blocks: b)
        found = {r.fp: r.component_id for r in sh.classes(spark, ids).collect()}
        assert [found[int(p)] for p in v.view(np.int64)] == want


def test_batches_of_whole_groups():
    import pandas as pd

    rnd = np.random.RandomState(2)
    df = pd.DataFrame({"fp": clusters(500, 2, 4).view(np.int64)[:400]})
    df["key"] = np.sort(rnd.randint(0, 5, len(df)))
    pairs = lambda parts: {tuple(r) for p in parts for r in p.to_numpy().tolist()}
    whole = pairs(sh.whole_groups([df]))
    assert pairs(sh.whole_groups([df.iloc[i : i + 9] for i in range(0, len(df), 9)])) == whole and whole


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=30))
def test_components(spark, edges):
    found = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "u long, v long"), Scratch(spark, "test")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root


def test_long_chain(spark):
    found = connected_components(spark.range(300).selectExpr("id as u", "id + 1 as v"), Scratch(spark, "test")).collect()
    assert len(found) == 301 and {r.root for r in found} == {0}


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds, plain = [], components.forest
    monkeypatch.setattr(components, "forest", lambda live, scratch, k: rounds.append(k) or plain(live, scratch, k))
    chain, star = [(i, i + 1) for i in range(300)], [(1000, 1001 + i) for i in range(300)]
    back, ring = [(3000 - i, 2999 - i) for i in range(300)], [(4000 + i, 4000 + (i + 1) % 300) for i in range(300)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + star + back + ring, "u long, v long"), Scratch(spark, "test")).collect()}
    assert found == {n: low for low, n in [*((0, i) for i in range(301)), *((1000, 1000 + i) for i in range(301)), *((2700, 2700 + i) for i in range(301)), *((4000, 4000 + i) for i in range(300))]}
    assert len(rounds) <= 9  # 1202 nodes, halved at least in each


def test_forest(spark):
    rnd = np.random.RandomState(5)
    edges = sorted({(min(a, b), max(a, b)) for a, b in rnd.randint(0, 400, (700, 2)).tolist() if a != b})
    for k in range(2):
        found = {r.node: r.parent for r in components.forest(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), k).collect()}
        assert set(found) == {x for e in edges for x in e}
        assert all(found[p] == p for p in found.values())
        assert 2 * len(set(found.values())) <= len(found)
