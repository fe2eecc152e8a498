"""Near copies by exact similarity, against every pair."""

import random

import pytest
import samples

from lodestone.llm import near_copies


def shingles(text):
    w = samples.split(samples.low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_kept(rows):
    """The rows (id, text) that stay: of each group the least id, and of rows that repeat an id one text."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                root[find(i)] = find(j)
    least, out = {}, []
    for i, (d, t) in enumerate(rows):
        if d is None:
            out.append((d, t))
        elif find(i) not in least or d < least[find(i)][0]:
            least[find(i)] = (d, t)
    return [*out, *least.values()]


def plain(rows):
    return sorted([d for d, _ in plain_kept(rows)], key=repr)


def edited(text, n, seed):
    rnd, w = random.Random(seed), text.split()
    for i in rnd.sample(range(len(w)), n):
        w[i] = f"new{rnd.random()}"
    return " ".join(w)


def near():
    """Texts around the similarity, chains of them, and boilerplate that all share."""
    common, out = " ".join(samples.words(70, 40)), []
    for k in range(12):
        base = common + " " + " ".join(samples.words(400 + k, 160))
        out += [base, *(edited(base, n, 10 * k + n) for n in (1, 2, 3, 4, 5, 6, 8))]
        out.append(edited(out[-5], 3, k))
    ids = random.Random(1).sample(range(1000, 5000), len(out))
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("rounds, part", [((2, 6, 16), 2048), ((16,), 5), ((1, 2, 16), 3)])
def test_every_near_copy_is_found(spark, monkeypatch, rounds, part):
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "PART_NODES", part)
    rows = near() + samples.texts()
    kept = near_copies.deduplicated(spark, samples.frame(spark, rows))
    assert kept.columns == samples.frame(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == plain(rows)


def test_near_copies_that_simhash_misses(spark):
    rows = [(1, " ".join(samples.words(3, 200)))]
    rows.append((2, edited(rows[0][1], 4, 2)))
    assert [r.doc_id for r in near_copies.deduplicated(spark, samples.frame(spark, rows)).collect()] == [1]


def test_no_rows(spark):
    assert near_copies.deduplicated(spark, samples.frame(spark, [])).collect() == []


def test_rows_that_repeat_an_id(spark):
    a, b, c = (" ".join(samples.words(k, 60)) for k in (21, 22, 23))
    rows = [(1, a), (3, f" {a}"), (3, b), (2, c), (2, c), (2, f" {c}")]
    kept = near_copies.deduplicated(spark, samples.frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text.strip()) for r in kept) == [(1, a), (2, c), (3, b)]
