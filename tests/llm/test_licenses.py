"""Words that decide between licenses."""

import difflib
import random
import re
import textwrap

import pytest
import zstandard

from lodestone.llm import licenses

T = licenses.TEMPLATES
GIVEN = tuple(T.items())


@pytest.mark.parametrize(
    "text, template, differing",
    [
        ("Released under the BSD License.", "MIT", "-mit +bsd"),
        ("Licensed under CC BY 4.0.", "CC-BY-NC-4.0", "-by-nc +by"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-2.0", "-2 +1.1"),
        (T["GPL-3.0"].replace("version 3", "version 2"), "GPL-3.0", "-3 +2"),
        (T["GPL-3.0"].replace("General", "Lesser General"), "GPL-3.0", "+lesser"),
        (T["CC-BY-4.0"].replace("Attribution", "Attribution-NonCommercial"), "CC-BY-4.0", "-attribution +attribution-noncommercial"),
        (T["GPL-3.0-header"].replace("version 3", "version 2"), "GPL-3.0-header", "-3 +2"),
        (T["MIT-text"].replace("free of charge", "for a fee"), "MIT-text", "-free -of -charge +for +a +fee"),
        ("not released under the MIT License", "MIT", ""),
    ],
)
def test_a_deciding_word_refutes(text, template, differing):
    name, *_, confirmed, _, words = licenses.compared(text, GIVEN)
    assert (name, confirmed, words) == (template, False, differing)


@pytest.mark.parametrize(
    "text, template",
    [
        *((text, name) for name, text in GIVEN),
        ("Licensed under the MIT licence.", "MIT"),
        ("Released under the terms of the MIT License", "MIT"),
        (T["GPL-3.0"].replace("version 3", "version 3.0"), "GPL-3.0"),
        (T["Apache-2.0-header"].replace("http:", "https:"), "Apache-2.0-header"),
        (T["GPL-3.0-header"].replace("This program", "Lodestone"), "GPL-3.0-header"),
    ],
)
def test_other_words_may_differ(text, template):
    name, *_, confirmed, _, _ = licenses.compared(text, GIVEN)
    assert (name, confirmed) == (template, True)


def test_differing_words_are_reported(spark):
    docs = spark.createDataFrame([(1, "Released under the BSD License."), (2, T["MIT"])], "doc_id long, text string")
    assert {(r.doc_id, r.confirmed, r.differing) for r in licenses.notices(docs).collect()} == {(1, False, "-mit +bsd"), (2, True, "")}


def wrapped(text, width=60, prefix=""):
    return "\n".join(prefix + line for line in textwrap.wrap(text, width))


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("name", list(T))
def test_wrapped_notices_are_whole(name, prefix):
    notice = wrapped(T[name], 60, prefix)
    text = f"prose\n\n{prefix}Copyright (c) 2020 Jo Doe\n{prefix.rstrip()}\n{notice}\n\nmore prose"
    found = [r for r in licenses.rows_of(text, GIVEN) if r[7]]
    assert [(r[2], r[6]) for r in found] == [(name, 0)]
    assert text[found[0][0] : found[0][1]] == notice[len(prefix) :]


@pytest.mark.parametrize("between", ["\n", " ", "\nsome words of prose\n"])
def test_every_notice_of_a_block_has_its_span(between):
    texts = [T["Apache-2.0"], T["MIT"], T["CC-BY-NC-4.0"], T["MIT"]]
    text = between.join(texts)
    found = list(licenses.rows_of(text, GIVEN))
    assert [(r[2], r[7]) for r in found] == [("Apache-2.0", True), ("MIT", True), ("CC-BY-NC-4.0", True), ("MIT", True)]
    assert [text[r[0] : r[1]] for r in found] == texts


def test_what_is_not_confirmed_beside_a_notice_stays_a_row():
    text = f"{T['MIT']}\nLicensed under the Apache License, Version 1.1."
    assert [(r[2], r[7], text[r[0] : r[1]]) for r in licenses.rows_of(text, GIVEN)] == [("MIT", True, T["MIT"]), ("Apache-2.0", False, text.split("\n")[1])]


def test_a_long_block_is_searched_whole():
    prose = "word and more " * 5000
    text = prose + T["BSD"] + " " + prose + T["MIT"] + " " + prose
    assert [(r[2], text[r[0] : r[1]]) for r in licenses.rows_of(text, GIVEN) if r[7]] == [("BSD", T["BSD"]), ("MIT", T["MIT"])]


def plain_words(text):
    """Words in one spelling, with their places."""
    out = []
    for m in re.finditer(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", "".join(c.lower() if c.isascii() else c for c in text)):
        word = m[0].replace("licence", "license")
        while re.search(r"\d\.0$", word):
            word = word[:-2]
        out.append((m.start(), m.end(), word))
    return out


def plain_confirmed(block):
    """(start, end, template) by trying every span of the block's words for every template, without what is part of a longer one.

    A span confirms if some alignment, of least cost (2 for a word that the template has and the span lacks or changes, 1 for one that the span adds), leaves no
    deciding word out or over. Blocks here are short, so that least costs are unique enough to tell.
    """
    own, fits = plain_words(block), []
    words = [w for _, _, w in own]
    for name, text in GIVEN:
        t = [w for _, _, w in plain_words(text)]
        limit = licenses.MOST_MISSING * len(t) // 100
        for a in range(len(words)):
            if words[a] != t[0] and words[a] not in t[: limit + 2]:
                continue
            for b in range(max(a + 1, a + len(t) - limit), min(len(words), a + len(t) + max(licenses.MOST_ADDED, limit)) + 1):
                ops = [o for o in difflib.SequenceMatcher(None, t, words[a:b], autojunk=False).get_opcodes() if o[0] != "equal"]
                lacking = [w for _, i, j, _, _ in ops for w in t[i:j]]
                added = [w for _, _, _, i, j in ops for w in words[a + i : a + j]]
                if len(lacking) <= limit and not any(licenses.decides(w, len(t) < licenses.SHORT) for w in lacking + added) and not (a and words[a - 1] in ("not", "never", "no", "non")):
                    fits.append((len(lacking) * 2 + len(added), a, b, name, len(t)))
    best = {}
    for cost, a, b, name, n in sorted(fits):  # of spans that overlap the one of least cost
        if not any(name == m and a < y and x < b for x, y, m, _ in best):
            best[a, b, name, n] = cost
    kept = [x for x in best if not any(y[0] <= x[0] and x[1] <= y[1] and y[3] > x[3] for y in best)]
    return sorted((own[a][0], name) for a, b, name, _ in kept)


def made(rnd):
    """A text of notices, whole, with a word changed or left out, wrapped or prefixed, between words of prose, and what must be confirmed in it."""
    parts, want, at = [], [], 0
    for _ in range(rnd.randint(1, 4)):
        parts.append(" ".join(rnd.choice(["prose", "value", "then", "output", "river"]) for _ in range(rnd.randint(1, 12))) + rnd.choice([". ", "\n", "\n\n"]))
        at += len(parts[-1])
        name, text = rnd.choice(GIVEN)
        how = rnd.choice(["whole", "whole", "wrapped", "changed", "neutral"])
        words = text.split(" ")
        if how == "changed" and name == "Apache-2.0-header":  # a short notice stands at its head
            how = "whole"
        if how == "changed":
            i = rnd.choice([i for i, w in enumerate(words) if any(licenses.decides(x, len(words) < licenses.SHORT) for _, _, x in plain_words(w))])
            words[i] = "otherwise"
        elif how == "neutral" and len(words) >= licenses.SHORT:
            i = rnd.choice([i for i, w in enumerate(words) if i and w.isalpha() and not licenses.decides(w.lower(), False)])
            words[i] = "whatever"
        said = " ".join(words)
        said = textwrap.fill(said, 50).replace("\n", "\n" + rnd.choice(["", "# ", " * "])) if how == "wrapped" else said
        if how != "changed":
            want.append((at, name))
        parts.append(said)
        at += len(said)
        parts.append("\n\n")
        at += 2
    return "".join(parts), want


@pytest.mark.parametrize("seed", range(25))
def test_against_every_span(seed):
    text, want = made(random.Random(seed))
    rows = list(licenses.rows_of(text, GIVEN))
    found = sorted((r[0], r[2]) for r in rows if r[7])
    assert found == sorted(want)
    assert found == sorted((a + s, name) for a, b in licenses.blocks_of(text) for s, name in plain_confirmed(text[a:b]))
    raw = {name: zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, t in GIVEN}
    for start, end, name, alone, size, *_ in rows:
        part = text[start:end].lower().encode()
        assert alone == len(zstandard.ZstdCompressor(level=19).compress(part)) and size == len(raw[name].compress(part))
