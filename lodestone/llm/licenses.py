"""License scans by conditional compression.

Paragraphs with a cue of licensing are candidate blocks. Each template whose wording stands in a block is confirmed, with
the span it has there: few words may differ, and of those that tell licenses apart none. What has a cue and is part of no
such span is a row of its own, with the template that ranks first. Ranks are by compression with each template as a raw
zstandard dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import arrow_pass, pick, spread, table, with_row

#: What may stand between two words: a notice may be wrapped, and each line prefixed as a comment.
GAP = r"[\s#*/;%-]+"
CUE = rf"(?i)licen[cs]e|copyright|all{GAP}rights{GAP}reserved|public{GAP}domain|warrant(?:y|ies)|permission{GAP}is{GAP}hereby|redistribut|spdx"
#: Most words, in hundredths of the template's, that a confirmed block may lack or have changed.
MOST_MISSING = 20
#: Words that a confirmed block may add inside a template, whatever its length; of longer ones as many as it may lack.
MOST_ADDED = 6
#: A template of fewer words is a short notice: each of its words decides, but for those of NEUTRAL.
SHORT = 20
NEUTRAL = frozenset("a an the this these that it its is are be work works file files program library software code source project package module document documents text content "
                    "licensed released distributed published provided available made under of by in into and or to with for terms term conditions condition following see license licenses rem dnl".split())  # fmt: skip
#: Words that decide in templates of any length: names, clauses, negations. Words with a digit decide too.
DECIDING = frozenset("mit bsd isc apache gpl lgpl agpl gnu lesser affero general public mozilla mpl cc creative commons attribution noncommercial commercial sharealike share alike noderivatives noderivs derivatives derivative "
                     "nc nd sa cc0 unported international eclipse epl cddl artistic zlib boost unlicense wtfpl proprietary domain only later any without not no non never except prohibited forbidden free fee charge cost royalty "
                     "academic educational research personal nonprofit internal evaluation waived granted permitted".split())  # fmt: skip
#: Notices as their licenses publish them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


@cache
def compressors(templates: tuple[tuple[str, str], ...]) -> tuple:
    """A compressor without a dictionary, and one for each template with what it saves of the template itself."""
    import zstandard as z

    plain = z.ZstdCompressor(level=19)
    out = []
    for name, text in templates:
        raw = z.ZstdCompressionDict(text.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        out.append((name, words_of(text), z.ZstdCompressor(level=19, dict_data=raw)))
    return plain, out


def words_of(text: str) -> list[str]:
    return [w for _, _, w in placed_words(text)]


def placed_words(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word), in one spelling: 2.0 as 2, licence as license."""
    found = re.finditer(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return [(m.start(), m.end(), re.sub(r"(?<=\d)(?:\.0)+$", "", m[0]).replace("licence", "license")) for m in found]


def decides(word: str, short: bool) -> bool:
    """Whether licenses differ if the word does."""
    return any(c.isdigit() for c in word) or not DECIDING.isdisjoint(re.split("[.-]", word)) or (short and word not in NEUTRAL)


#: Words of a text that are laid against a template at once.
CHUNK = 4096


def laid(own: list[str], words: list[str], best: bool = False) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """Places where the template's words stand in own: (first, end, lacking words, added words), the best first.

    An alignment of the whole template with any part of own; a lacking or changed word costs 2, an added one 1. Only places
    near enough to be confirmed; with best, the best place of all, however bad.
    """
    n, code = len(words), {}
    w = np.array([code.setdefault(x, len(code)) for x in words])
    coded = np.array([code.get(x, -1) for x in own], np.int64)
    most = 2 * (MOST_MISSING * n // 100) + added_at_most(n)
    overlap = 2 * n + added_at_most(n)
    places = []
    for at in range(0, max(1, len(own)), CHUNK):
        lo = max(0, at - overlap)
        part = coded[lo : at + CHUNK]
        steps = np.arange(len(part) + 1)
        cost = np.zeros((n + 1, len(part) + 1), np.int64)
        for i in range(n):
            row = cost[i] + 2
            row[1:] = np.minimum(row[1:], cost[i][:-1] + 2 * (part != w[i]))
            cost[i + 1] = np.minimum.accumulate(row - steps) + steps
        ends = np.flatnonzero(cost[n] <= most)
        ends = [len(part) - int(np.argmin(cost[n][::-1]))] if best else ends[ends + lo > at if at else ends >= 0].tolist()
        for end in ends:
            i, j, lacking, added = n, end, [], []
            while i:
                if j and cost[i, j] == cost[i - 1, j - 1] + 2 * (part[j - 1] != w[i - 1]):
                    if part[j - 1] != w[i - 1]:
                        lacking.append(words[i - 1])
                        added.append(own[lo + j - 1])
                    i, j = i - 1, j - 1
                elif cost[i, j] == cost[i - 1, j] + 2:
                    lacking.append(words[i - 1])
                    i -= 1
                else:
                    added.append(own[lo + j - 1])
                    j -= 1
            places.append((int(cost[n, end]), lo + j, lo + end, lacking[::-1], added[::-1]))
    places.sort(key=lambda x: (x[0], -x[2]))
    yield from (p[1:] for p in (places[:1] if best else places))


def added_at_most(n: int) -> int:
    return max(MOST_ADDED, MOST_MISSING * n // 100)


def confirms(own: list[str], first: int, words: list[str], lacking: list[str], added: list[str]) -> bool:
    """Whether own says, from its word first on, what the template says: no word that decides differs, few others do, and no negation stands before."""
    n, short = len(words), len(words) < SHORT
    if 100 * len(lacking) > MOST_MISSING * n or len(added) > len(lacking) + added_at_most(n):
        return False
    return not any(decides(x, short) for x in [*lacking, *added]) and not (first and own[first - 1] in ("not", "never", "no", "non"))


def blocks_of(text: str) -> Iterator[tuple[int, int]]:
    """Paragraphs with a cue: lines up to a blank one. A line with only a comment's prefix isn't blank."""
    at, held = 0, None
    for line in [*text.split("\n"), ""]:
        if line.strip():
            held = (held[0] if held else at, at + len(line))
        elif held:
            if re.search(CUE, text[held[0] : held[1]]):
                yield held
            held = None
        at += len(line) + 1


def standing(block: str, templates: tuple[tuple[str, str], ...]) -> list[tuple]:
    """(start, end, template, its words, lacking words, added words) of each confirmed wording in the block; one that is part of a longer one is left out."""
    found = placed_words(block)
    own = [w for _, _, w in found]
    there, out = set(own), []
    for name, words, _ in compressors(templates)[1]:
        if any(decides(w, len(words) < SHORT) and w not in there for w in words):
            continue
        taken: list[tuple[int, int]] = []
        for first, end, lacking, added in laid(own, words):
            if all(end <= a or b <= first for a, b in taken) and confirms(own, first, words, lacking, added):
                taken.append((first, end))
                out.append((first, end, name, len(words), lacking, added))
    out = [x for x in out if not any(y[0] <= x[0] and x[1] <= y[1] and (y[3], y[2]) > (x[3], x[2]) for y in out)]
    return sorted((found[a][0], closed(block, found[b - 1][1]), *rest) for a, b, *rest in out)


def closed(block: str, end: int) -> int:
    """The end of a sentence whose last word ends at end."""
    return end + len(re.match(r"[/.:;)\"']*", block[end:])[0])


def rows_of(text: str, templates: tuple[tuple[str, str], ...]) -> Iterator[tuple]:
    for a, b in blocks_of(text):
        rest = 0
        for start, end, name, n, lacking, added in standing(text[a:b], templates):
            yield from unsettled(text, a + rest, a + start, templates)
            alone, ranked = ranks(text[a + start : a + end], templates)
            saved = next(x[0] for x in ranked if x[1] == name)
            yield a + start, a + end, name, alone, alone - saved, n, len(lacking), True, next((x[1] for x in ranked if x[1] != name), None), differing(lacking, added)
            rest = max(rest, end)
        yield from unsettled(text, a + rest, b, templates)


def unsettled(text: str, a: int, b: int, templates: tuple[tuple[str, str], ...]) -> Iterator[tuple]:
    """What no confirmed wording covers, if it has a cue."""
    part = text[a:b]
    if re.search(CUE, part):
        a, b = a + len(part) - len(part.lstrip()), a + len(part.rstrip())
        yield a, b, *compared(text[a:b], templates)


def ranks(block: str, templates: tuple[tuple[str, str], ...]) -> tuple[int, list[tuple[int, str, list[str]]]]:
    """The size of the block alone, and (bytes saved, template, its words), the most saved first."""
    plain, each = compressors(templates)
    data = block.lower().encode()
    alone = len(plain.compress(data))
    return alone, sorted(((alone - len(c.compress(data)), name, words) for name, words, c in each), key=lambda x: (-x[0], x[1]))


def compared(block: str, templates: tuple[tuple[str, str], ...]) -> tuple:
    """Best template, the block's size alone and with it, the template's words, those missing from or changed in the block, whether it is confirmed, the runner-up, and the differing words."""
    alone, ranked = ranks(block, templates)
    own = words_of(block)
    # Templates that begin alike save alike: among those near the top the exact wording decides.
    close = [r for r in ranked if r[0] >= ranked[0][0] - 8]
    fits = []
    for saved, name, words in close:
        first, _, lacking, added = next(laid(own, words, best=True))
        fits.append((not confirms(own, first, words, lacking, added), len(lacking) / len(words), -saved, name, len(words), lacking, added))
    refuted, _, saved, name, n, lacking, added = min(fits)
    return name, alone, alone + saved, n, len(lacking), not refuted, next((x[1] for x in ranked if x[1] != name), None), differing(lacking, added)


def differing(lacking: list[str], added: list[str]) -> str:
    return " ".join([*("-" + x for x in lacking), *("+" + x for x in added)])


def notices(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, block_start, block_end, template, size_alone, size_with, n_words, n_missing, confirmed, runner_up, differing.

    A row for each confirmed wording, with its own span (in code points), and one for each part of a block with a cue that
    none covers: the template that ranks first, not confirmed. differing has the words in which they differ, -lacking and +added. Texts without a cue, null and empty ones have no rows. Nothing is grouped, so repeated rows are scanned each
    for itself. Other columns are ignored.
    """
    given = tuple((templates or TEMPLATES).items())
    own = pick(docs, "doc_id", "text").select(F.struct("doc_id").alias("row"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(CUE))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [(i, *row) for i, t in enumerate(batch.column(1).to_pylist()) for row in rows_of(t, given)]
        if out:
            at, *rest = zip(*out, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(x, k) for x, k in zip(rest, kinds, strict=True)]], ["row", *names])

    names = ["block_start", "block_end", "template", "size_alone", "size_with", "n_words", "n_missing", "confirmed", "runner_up", "differing"]
    i, s = T.IntegerType(), T.StringType()
    schema = with_row(own, *zip(names, (i, i, s, i, i, i, i, T.BooleanType(), s, s), strict=True))
    return arrow_pass(own, run, schema).select("row.doc_id", *names)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spread(table(spark, sf_dir, "documents")))
