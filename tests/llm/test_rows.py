"""BPE, token counts, licenses, URLs, sharding and the pipeline."""

import base64
import bisect
import hashlib
import math
import os
import random
import sys
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import samples
import tiktoken

import corpus_pipeline
from lodestone.llm import bpe, licenses, sharding, tokens, urls

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import test_near_copies
import test_spans

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
STRANGE = ["", " ", "<|endoftext|> it's  we'll\n\n x", "a\u0085b\u00a0c\u2003d\u180ee", "ﷺ漢字😀👩‍👩‍👧 e\u0301", "x" * 5000, "\x00\x01\x7f", "12 345\t\t6", "ﬀ\ufffd\U0010ffff"]


def plain_offsets(text, ids):
    """Start and end of each token in characters, from the bytes before it."""
    out, place, data = [], 0, text.encode()
    pieces = {i: p for p, i in RANKS.items()}
    ends = [0]  # the byte where each character ends
    for c in text:
        ends.append(ends[-1] + len(c.encode()))
    for i in ids:
        a, b = place, place + len(pieces[i])
        start = bisect.bisect_right(ends, a) - 1
        out.append((start, bisect.bisect_left(ends, b)))
        place = b
    assert place == len(data)
    return out


def digests_of(text, ids):
    pack = lambda xs: hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in xs)).hexdigest()
    return pack(ids), hashlib.sha256(text.encode()).hexdigest(), pack(x for pair in plain_offsets(text, ids) for x in pair)


def test_bpe(spark):
    rows = samples.texts() + [(50 + k, t) for k, t in enumerate(STRANGE)]
    want = []
    for i, t in rows:
        ids = ENCODING.encode_ordinary(t or "")
        want.append((i, len(ids), *digests_of(t or "", ids)))
    found = bpe.digests(samples.frame(spark, rows), keep=True)
    assert samples.got(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256") == sorted(want, key=repr)
    for r in found.collect():
        assert len(r.ids) == r.n_tokens
    assert bpe.digests(samples.frame(spark, [])).collect() == []


def test_ranks_and_vocabulary_are_the_same():
    assert {p: i for i, p in enumerate(bpe.codec(bpe.VOCABULARY)[1]) if i < len(RANKS)} == RANKS


def test_every_code_point_splits_alike():
    texts = ["".join(f"a{chr(c)}b 1{chr(c)} !{chr(c)}  {chr(c)}\n" for c in range(k, k + 512) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 512)]
    for text, ids in bpe.encoded(pa.array(texts)):
        assert ids.tolist() == ENCODING.encode_ordinary(text)


def test_offsets_and_decoding(spark):
    for text, ids in bpe.encoded(pa.array(STRANGE)):
        a, b = bpe.character_offsets(text, ids)
        place, data = 0, text.encode()
        for s, e, i in zip(a, b, ids, strict=True):
            piece = bpe.codec(bpe.VOCABULARY)[1][i]
            whole = text[s:e].encode()
            assert piece in whole and len(text[s:e]) >= 1 and len(data[:place].decode("utf-8", "ignore")) in (s, s + 0)
            place += len(piece)
        assert place == len(data)
    rows = samples.frame(spark, [(k, t) for k, t in enumerate(STRANGE)]).selectExpr("struct(doc_id) as row", "text")
    back = bpe.with_text(bpe.with_ids(rows).select("row", "ids")).collect()
    assert {r.row.doc_id: r.decoded for r in back} == dict(enumerate(STRANGE))
    half = bpe.with_ids(rows).where("row.doc_id = 4").selectExpr("row", "slice(ids, 1, 1) as ids")
    assert bpe.with_text(half).first().decoded  # a part of a character becomes a mark, not an error


def test_counts_follow_edits():
    rnd, count = random.Random(4), tokens.counts(tokens.RANKS)
    signs = "ab  \n\n'sré1.,! tion's😀漢"
    for _ in range(400):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randrange(900)))
        tree = tokens.TokenTree(t, count)
        for _ in range(6):
            a = rnd.randrange(len(t) + 3)
            b = a + rnd.randrange(40)
            new = "".join(rnd.choice(signs) for _ in range(rnd.randrange(rnd.choice([3, 700]))))
            tree.edit(a, b, new)
            a = min(a, len(t))
            t = t[:a] + new + t[max(a, min(b, len(t))) :]
            assert tree.text() == t and tree.chars == len(t) and tree.tokens == len(ENCODING.encode_ordinary(t))
            assert [p for leaf in tree.leaves for p in leaf] == tokens.splitter().findall(t)


def test_an_edit_touches_little():
    t = " ".join(samples.words(2, 20_000))
    tree = tokens.TokenTree(t, tokens.counts(tokens.RANKS))
    assert tree.edit(len(t) // 2, len(t) // 2 + 3, "new words") < 100


def test_token_counts(spark):
    found = {}
    for r in tokens.revised(samples.frame(spark)).collect():
        found.setdefault(r.doc_id, []).append(r)
    for i, t in samples.texts():
        t = t or ""
        edited = t
        for a, b, new in ((len(t) // 4, len(t) // 4, " [editor's note] "), (len(t) // 2, len(t) // 2 + 12, ""), (len(t) * 3 // 4, len(t) * 3 // 4 + 5, "reworded")):
            a, b = min(a, len(edited)), min(b, len(edited))
            edited = edited[:a] + new + edited[b:]
        assert (len(t), len(ENCODING.encode_ordinary(t)), 3, len(ENCODING.encode_ordinary(edited))) in [tuple(r)[1:5] for r in found[i]]
    assert tokens.revised(samples.frame(spark, [])).collect() == []
    odd = spark.createDataFrame([("a b", None), (None, [(None, None, None), (5, 1, "x")])], "text string, edits " + tokens.EDITS).selectExpr("struct(text, edits) as row", "text")
    kept = tokens.trees(odd).select("*", "row.edits")
    assert sorted((r.n_chars, r.n_tokens, r.n_edits, r.text) for r in tokens.edited(kept).collect()) == [(1, 1, 2, "x"), (3, 2, 0, "a b")]


def test_kept_trees_are_edited_again(spark, tmp_path, monkeypatch):
    """Trees written, read and edited twice; the second time no text may be split as a whole."""
    rows = [(i, t) for i, t in samples.texts() if t]
    own = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("struct(doc_id) as row", "text")
    tokens.trees(own).write.parquet(str(tmp_path / "t0"))
    want = [t for _, t in rows]
    for k, (start, end, new) in enumerate([(10, 14, "some new words"), (40, 40, "x y'll "), (0, 3, "")]):
        before = spark.read.parquet(str(tmp_path / f"t{k}"))
        edits = f"array(struct({start} as start, {end} as end, {new!r} as new))" if "'" not in new else f'array(struct({start} as start, {end} as end, "{new}" as new))'
        after = tokens.edited(before.selectExpr("row", "text", "piece_chars", "piece_tokens", f"{edits} as edits"))
        after.write.parquet(str(tmp_path / f"t{k + 1}"))
        want = [t[: min(start, len(t))] + new + t[max(start, min(end, len(t))) :] for t in want]
        found = spark.read.parquet(str(tmp_path / f"t{k + 1}")).collect()
        assert sorted((r.text, r.n_tokens) for r in found) == sorted((t, len(ENCODING.encode_ordinary(t))) for t in want)
        assert all(sum(r.piece_chars) == len(r.text) and sum(r.piece_tokens) == r.n_tokens for r in found)
        assert all(r.n_recounted_chars < 600 for r in found if max(r.piece_chars) < 100)


def test_licenses(spark):
    t = licenses.TEMPLATES
    rows = [(1, f"prose\n{t['MIT']}\nmore"), (2, "x " * 200 + "\n" + t["Apache-2.0-header"].upper() + "\n\n" + t["CC-BY-NC-4.0"]), (3, "© all rights reserved by nobody in particular"), (4, t["GPL-3.0"].replace("version 3", "version 2")), (5, None), (6, ""), (7, "no cue"), (None, t["BSD"]), (8, t["MIT-text"].replace("free of charge", "for a fee")), (8, t["MIT-text"])]
    found = [(r.doc_id, r.template, r.confirmed, r.n_missing) for r in licenses.notices(samples.frame(spark, rows)).collect()]
    assert {(1, "MIT", True, 0), (2, "Apache-2.0-header", True, 0), (2, "CC-BY-NC-4.0", True, 0), (4, "GPL-3.0", False, 1), (None, "BSD", True, 0), (8, "MIT-text", True, 0)} <= set(found)
    assert any(i == 8 and n == 3 for i, _, _, n in found) and not any(c for i, _, c, _ in found if i == 3) and len(found) == 8
    for r in licenses.notices(samples.frame(spark, rows)).where("doc_id = 1").collect():
        assert rows[0][1][r.block_start : r.block_end] == t["MIT"] and r.size_with < r.size_alone
    assert licenses.notices(samples.frame(spark, [])).collect() == []


def test_urls(spark):
    pages = [
        (1, "http://Example.COM/en/7x?q"), (2, "https://a.b.example.com/en/8"), (3, "http://notexample.com/en/7"), (4, "http://x.net/de/"), (5, "ftp://example.net/de/8#f"), (6, "http://org/es/"), (7, "http://example.org/es"), (8, None), (9, "no scheme"), (10, "http://"), (11, "http://h.com?/en/"),
        (12, "http://h.info/ads/x"), (13, "http://h.info/login"), (14, "http://h.info/loginx"), (15, "http://ad.doubleclick.net/x"), (16, "http://h.com/EN/"), (17, "http://h.info/banner-7.gif"), (None, "http://h.com/en/"), (1, "http://Example.COM/en/7x?q"), (18, "a://b://c.com/en/"),
    ]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in pages], "page_id long, url string, html string, verdict string")
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judged(df).collect()}
    assert {
        (1, "example.com", "/en/7x", "example.com/en/7", "allow"), (2, "a.b.example.com", "/en/8", "com/en/", "block"), (3, "notexample.com", "/en/7", "com/en/", "block"), (4, "x.net", "/de/", "net/de/", "allow"), (5, "example.net", "/de/8", "example.net/de/8", "block"), (6, "org", "/es/", "org/es/", "block"),
        (7, "example.org", "/es", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "h.com", "", None, "allow"), (12, "h.info", "/ads/x", None, "block"), (13, "h.info", "/login", None, "block"), (14, "h.info", "/loginx", None, "allow"),
        (15, "ad.doubleclick.net", "/x", None, "block"), (16, "h.com", "/EN/", None, "allow"), (17, "h.info", "/banner-7.gif", None, "block"), (None, "h.com", "/en/", "com/en/", "block"), (18, "b:", "//c.com/en/", None, "allow"),
    } == found
    assert urls.judged(df).count() == len(pages) and urls.judged(df.limit(0)).collect() == []


def test_url_index_finds_what_trying_all_rules_finds(spark):
    rules = (*urls.LISTED, *urls.GENERAL)
    by = urls.filed(spark.createDataFrame([(1, "http://example.com/en/7")], "page_id long, url string"), rules)
    assert sorted(r.pattern for v in by.values() for r in v) == sorted(r.pattern for r in rules)
    for key, filed in by.items():
        for r in filed:
            assert key in r.tokens() or not r.tokens()


def test_index_of_many_rules():
    """10,000 rules and URLs over a small alphabet: what the index fetches fits just where trying all does."""
    rnd = random.Random(12)
    some = ["login", "ads", "a", "b1", "x", "ADS", "k", "\u212a", "\u017f", "login\u212a", "7"]
    join = lambda signs, n: "".join(rnd.choice(some) + rnd.choice(signs) for _ in range(n))
    rules = tuple(dict.fromkeys(urls.Rule("block", rnd.choice(["||", "", "/", "*", "."]) + join("./-_%^*", rnd.randint(1, 4)) + rnd.choice(["", "^", "*", "q"])) for _ in range(10_000)))
    seen = {t: rnd.randrange(1000) for r in rules for t in r.tokens()}
    by, fits = urls.by_rarest(rules, seen), 0
    for _ in range(150):
        host, path, rest = urls.parts("http://" + join(".", 2) + "com" + rnd.choice(["", "/" + join("./-_%?#", 4), "/x" + join("/-", 2)]))
        want = {r for r in rules if r.regex.search(host + path + rest)}
        assert {r for r in urls.fetched(host + path + rest, by) if r.regex.search(host + path + rest)} == want
        fits += len(want)
    assert fits > 1000


def plain_shard(key, shards, growth=()):
    """The leaf: regions, then racks, then shards draw, and what has grown draws with the regions."""
    draw = lambda name, weight: -math.log((int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / weight
    weight = lambda path: sum(s.weight for s in shards if f"{s.leaf}/".startswith(f"{path}/"))
    best = min([(draw(r, weight(r)), r) for r in {s.region for s in shards}] + [(draw(f"+{i}:{s.leaf}", s.weight), s.leaf) for i, s in enumerate(growth)])[1]
    while best.count("/") < 2:
        best = min((draw(p, weight(p)), p) for p in {"/".join(s.leaf.split("/")[: best.count("/") + 2]) for s in shards if s.leaf.startswith(f"{best}/")})[1]
    return int(best.split("/")[2])


def test_shards(spark):
    rows = samples.texts() + [(1000 + k, "t") for k in range(3000)] + [(1000, "t")] * 500
    before, after = sharding.tree(24), sharding.tree(24).grown(sharding.next_shard(24))
    found = sharding.placed(spark, samples.frame(spark, rows), before, after).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    by, told = {}, {i: (plain_shard("" if i is None else i, before.shards), plain_shard("" if i is None else i, before.shards, after.growth)) for i, _ in rows}
    for r in found:
        assert (r.shard, r.grown_shard) == told[r.doc_id] and r.grown_shard in (r.shard, 24) and r.law == "key"
        assert (r.region, r.rack) == (f"region{r.shard % 2}", f"rack{r.shard // 2 % 3}")
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    new = {r.doc_id: r.shard for r in found if r.doc_id is not None and r.doc_id > 1000}
    each = [list(new.values()).count(s) for s in range(24)]
    assert max(each) < 2 * 3000 / 24 and min(each) > 0.5 * 3000 / 24
    moved = sum(r.grown_shard == 24 for r in found if r.doc_id is not None and r.doc_id > 1000) / 3000
    assert 0.025 < moved < 0.055  # a 25th
    assert sharding.placed(spark, samples.frame(spark, []), before, after).collect() == []


def test_weights(spark):
    own = sharding.Tree((sharding.Shard("a", "x", 0, 1.0), sharding.Shard("a", "y", 1, 3.0), sharding.Shard("b", "x", 2, 4.0)))
    grown = own.grown(sharding.Shard("a", "y", 1, 8.0))
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(sharding.descend(F.col("id"), own)["shard"].alias("s"), sharding.descend(F.col("id"), grown)["shard"].alias("g")).groupBy("s", "g").count().collect()
    share = lambda c, k: sum(r["count"] for r in df if r[c] == k) / 20_000
    assert all(math.isclose(share("s", k), w / 8, abs_tol=0.015) for k, w in enumerate((1, 3, 4)))
    assert all(math.isclose(share("g", k), w / 16, abs_tol=0.015) for k, w in enumerate((1, 11, 4)))
    assert all(r.g in (r.s, 1) for r in df)


def test_a_large_tree_is_one_small_expression(spark):
    from pyspark.sql import functions as F

    found = spark.range(2000).select(sharding.descend(F.col("id"), sharding.tree(600, 6, 10))["shard"].alias("s")).collect()
    assert len({r.s for r in found}) > 500


def test_names_and_weights_of_any_kind(spark):
    from pyspark.sql import functions as F

    shards = tuple(sharding.Shard(r, k, i, w) for i, (r, k, w) in enumerate([("o'hare", "a\\b", 1e-5), ("o'hare", '"c"', 2e-5), ("${x}", "é\n%", 1e-5)]))
    rows = spark.range(300).select("id", sharding.descend(F.col("id"), sharding.Tree(shards)).alias("to")).collect()
    assert [(r.to.region, r.to.rack, r.to.shard) for r in rows] == [next((s.region, s.rack, s.shard) for s in shards if s.shard == plain_shard(r.id, shards)) for r in rows]
    big = sharding.Tree(tuple(sharding.Shard("r", "k", i, w) for i, w in enumerate((1e16, 1e-7))))
    assert {r[0] for r in spark.range(50).select(sharding.descend(F.col("id"), big)["shard"]).collect()} == {0}


def test_writes_shards(spark, tmp_path):
    docs = spark.range(500).selectExpr("id as doc_id", "'t' as text")
    sharding.write_shards(spark, docs, str(tmp_path / "s"), sharding.tree(24))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 500 and len([p for p in os.listdir(tmp_path / "s") if p.startswith("shard=")]) == 24


@pytest.mark.parametrize("rows", [None, []])
def test_pipeline(spark, tmp_path, rows):
    rows = samples.texts() + [(60 + k, " ".join(samples.words(300 + k, 80)) + " token = 'abcdefgh12'") for k in range(4)] + [(80, " ".join(samples.words(301, 80)) + " Token = 'abcdefgh12'")] if rows is None else rows
    items = [(1, " ".join(samples.words(302, 80)[20:45])), (2, "short item")]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(i, t) for i, t in rows if (q := test_spans.plain_quality(t))[0] >= 20 and 100 * q[4] <= 30 * q[0] and 100 * q[5] <= 30 * q[1] and q[6] <= 250]
    kept = test_near_copies.plain_kept(kept)
    dirty = {(r[0], n) for n, (i, t) in enumerate(kept) for r in test_spans.plain_overlaps([(i, t)], items) if r[5]}
    kept = [(i, t) for n, (i, t) in enumerate(kept) if (i, n) not in dirty]
    want = []
    for i, t in kept:
        out, at = "", 0
        for a, _, b in test_spans.plain_secrets(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        out += t[at:]
        ids = ENCODING.encode_ordinary(out)
        want.append((i, len(ids), *digests_of(out, ids), ids))
    assert samples.got(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "ids") == sorted(want, key=repr)
    if rows:
        assert dirty and 80 not in {r[0] for r in want} and 61 in {r[0] for r in want}
