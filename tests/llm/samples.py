"""Small tables with everything that a row may have, and plain versions of what the operators do."""

import random

import regex

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, kept boolean, n_words string, text_key long, c0 string, gone long, words string, found string, shard int"
EXTRA = ("r", 1, None, "w", 2, "c", 3, "x", "f", 4)


def words(seed, n, many=400):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randint(2, 7))) for _ in range(many)]
    return [rnd.choice(vocabulary) for _ in range(n)]


def texts():
    """(doc_id, text): nulls, empty and blank texts, ties, repeats, copies, near copies, shared passages, a very long text."""
    passage = " ".join(words(100, 70))
    base = " ".join(words(1, 300))
    near = base.split()
    near[150] = "changed"
    out = [(0, base), (1, None), (2, ""), (3, " \n\t \r"), (None, base), (None, None), (4, base), (5, base), (5, base), (6, " ".join(near)), (7, " ".join(near).upper())]
    out += [(10 + k, " ".join(words(k + 5, 60) + passage.split() + words(k + 50, 40))) for k in range(6)]
    out += [(20, passage), (21, " ".join(passage.split()[:49])), (21, " ".join(passage.split()[10:65])), (22, passage.replace(" ", "\n  ", 3)), (23, "one"), (24, "one two"), (25, "one two three"), (26, "Ünïcode   tèxt\x0bhere 😀 漢字 \x1c not\x1csplit")]
    out += [(30, " ".join(words(9, 30) * 12)), (31, "same line here\n" * 30), (32, "short"), (33, " ".join(words(8, 40000)) + " " + passage), (34, "x" * 300_000)]
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *EXTRA) for i, t in rows], COLUMNS).repartition(3)


def split(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return regex.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def got(df, *columns):
    """Rows as tuples, sorted; repeated rows stay."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
