import numpy as np
import pyarrow as pa
import pytest
import samples

from lodestone.llm import words as w
from lodestone.llm.common import bloom, bloom_has, parted


def test_words_are_those_of_the_pattern():
    texts = [t for _, t in samples.texts()] + ["a", "", "b", "a b", " b"]
    found = []
    for b in w.blocks(pa.array(texts), limit=500):
        for d in range(b.hi - b.lo):
            found.append([b.data[s:e].tobytes().decode() for s, e in zip(b.start[b.word_at[d] : b.word_at[d + 1]], b.end[b.word_at[d] : b.word_at[d + 1]], strict=True)])
    assert found == [samples.split(t) for t in texts]
    sliced = pa.array(["zz", *texts])[1:]
    assert sum(len(b.start) for b in w.blocks(sliced)) == sum(map(len, found))


def test_equal_words_hash_alike_wherever_they_stand():
    b = next(w.blocks(pa.array([" ".join(samples.words(3, 5000))])))
    h = b.hashes()
    by = {}
    for s, e, x in zip(b.start, b.end, h, strict=True):
        assert by.setdefault(b.data[s:e].tobytes(), x) == x
    assert len(set(by.values())) == len(by)


def test_words_that_begin_alike_hash_apart():
    base = "x" * 40
    some = [base[:n] for n in range(1, 41)] + [base[:n] + "y" for n in range(40)] + ["y" + base[:n] for n in range(1, 40)] + ["\x00" * n for n in range(1, 20)]
    h = next(w.blocks(pa.array([" ".join(some)]))).hashes()
    assert len(set(h.tolist())) == len(set(some)) == len({int(x) >> 32 for x in h})


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


@pytest.mark.parametrize("size", [256, 512, 1024, 2048, 4096])
def test_patterns_that_defeat_polynomials(size):
    """Words, and spans of words, that any polynomial modulo 2**64 takes for equal."""
    one = thue_morse(size)
    other = one.translate(str.maketrans("ab", "ba"))
    h = next(w.blocks(pa.array([f"{one} {other}"]))).hashes()
    assert h[0] != h[1]
    h = next(w.blocks(pa.array([" ".join(one + other)]))).hashes()
    spans = w.span_hash(h, np.array([0, size]), np.array([size, 2 * size]))
    assert spans[0] != spans[1]


def test_spans_hash_by_content_alone():
    rnd = np.random.RandomState(5)
    values = rnd.randint(0, 3, 400).astype(np.uint64)
    start = rnd.randint(0, 380, 3000)
    end = np.minimum(start + rnd.randint(1, 20, 3000), 400)
    by = {}
    for a, b, x in zip(start.tolist(), end.tolist(), w.span_hash(values, start, end).tolist(), strict=True):
        assert by.setdefault(values[a:b].tobytes(), x) == x
    assert len(set(by.values())) == len(by)
    assert (w.windows(values, 7) == w.span_hash(values, np.arange(394), np.arange(394) + 7)).all() and len(w.windows(values, 500)) == 0


def test_sliding_argmin():
    rnd = np.random.RandomState(0)
    for n, k in ((1, 1), (5, 6), (50, 7), (1000, 43)):
        h = rnd.randint(0, 1 << 62, n).astype(np.uint64)
        h[n // 3 :: 4] = h[0]
        top = h >> np.uint64(20)
        want = [i + int(np.argmin(top[i : i + k])) for i in range(n - k + 1)]
        assert w.sliding_argmin(h, k).tolist() == want


def test_bloom_has_no_false_negatives(spark):
    values = np.random.RandomState(1).randint(-(1 << 63), (1 << 63) - 1, 5000)
    f = bloom(spark.createDataFrame([(int(x),) for x in values[:2500]] + [(None,)], "h long"), "h", 1 << 20)
    assert bloom_has(f, values[:2500]).all() and bloom_has(f, values[2500:]).mean() < 0.05
    assert not bloom_has(bloom(spark.createDataFrame([], "h long"), "h"), values).any()


def test_rows_are_parted_without_loss(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).selectExpr("id", "if(id % 7 = 0, null, 'x') as page_x")
    wanted = spark.range(0, 20_000, 50).select(F.xxhash64("id").alias("key")).unionByName(spark.createDataFrame([(None,)], "key long"))
    may, stay = parted(df, F.xxhash64("id"), wanted)
    a, b = ({r.id for r in x.collect()} for x in (may, stay))
    assert a | b == set(range(20_000)) and not a & b and set(range(0, 20_000, 50)) <= a and len(a) < 2000 and may.columns == [*df.columns, "key_"]
    may, stay = parted(df, F.xxhash64("id"), wanted.limit(0))
    assert may.count() == 0 and stay.count() == 20_000
