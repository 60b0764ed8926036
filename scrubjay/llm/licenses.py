"""License scan: MinHash bands over overlapping text windows, then exact containment (operator 2).

Templates and documents are sets of five-word shingles. A template of m
shingles is looked for in windows of ``2 * step`` shingles every ``step``,
step being the least power of two that is m or more, so every passage of m
shingles lies whole in some window. Window signatures double from level to
level: a block's minimum is the least of two halves', a window's the least of
two neighbouring blocks'. Each of the ``bands(similarity)`` bands is one row;
sharing one puts a window before a template, with a chance of missing under
``MISS``. Verification then counts the template's own shingles in the window.

Statements of a few words (``STATEMENTS``) are found as exact runs of words.

Templates are a fixed list and travel with the task; texts are read where they
lie, without a shuffle.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm import textnum

WORDS = 5
#: Least share of a template's shingles that a window must hold.
CONTAINMENT = 0.8
#: Most words of a template that the words before it may deny.
ONE_LINE = 16
#: Greatest chance that the bands miss a window holding that share.
MISS = 1e-6

# Public license statements and notices.
TEMPLATES = {
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0",
    "MIT statement": "Released under the MIT License",
    "MIT short": "Licensed under the MIT License",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "BSD notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "MIT text": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSD-3-Clause text": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib text": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "BSL-1.0 text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    # of the GNU notices the words that tell them apart: less than CONTAINMENT of one is in another
    "GPL-2.0 notice": "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-2.0-only notice": "terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "GPL-3.0 notice": "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "LGPL-2.0 notice": "terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License",
    "LGPL-2.1 notice": "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "LGPL-3.0 notice": "terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL-3.0 notice": "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MPL-1.1 notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "GFDL notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    # long texts by passages that no other license has
    "Apache-2.0 text": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "GPL-2.0 text": "The act of running the Program is not restricted, and the output from the Program is covered only if its contents constitute a work based on the Program",
    "GPL-3.0 text": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "LGPL-2.1 text": "This License Agreement applies to any software library or other program which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Lesser General Public License",
    "LGPL-3.0 text": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "AGPL-3.0 text": "specifically designed to ensure cooperation with the community in the case of network server software.",
    "MPL-2.0 text": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions",
    "Artistic-1.0 text": "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package",
    "CC0-1.0 text": "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights",
}


def _gnu(short: str, long: str, version: str) -> tuple[str, ...]:
    """A bare number counts after "GNU GPL" alone, and with one space before it: else it may be the number of a section."""
    whole = version if "." in version else f"{version}.0"
    said = {f"{name} {v}" for name in (long, f"GNU {short}", short) for n in (version, whole) for v in (f"version {n}", f"v{n}")}
    return (*sorted(said), f"{short} {whole}", f"{short}v{version}", f"GNU {short} {version}", f"{long} {whole}")


def _cc(code: str, *long: str) -> dict[str, tuple[str, ...]]:
    return {f"CC-{code}-{v} statement": (f"CC {code} {v}", *(f"Creative Commons {name} {v}" for name in long)) for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}


# The distinctive words of short statements, whatever stands around them.
STATEMENTS = {
    "Apache-2.0 statement": ("Apache License Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License v2", "Apache 2.0", "Apache Software License 2.0",
                             "Apache Software License Version 2.0"),
    "MIT statement": ("MIT License", "MIT licensed", "SPDX-License-Identifier: MIT"),
    "BSD statement": ("BSD License", "BSD licensed"),
    "BSD-2-Clause statement": ("BSD 2-Clause", "2-Clause BSD", "Two-Clause BSD", "Simplified BSD", "FreeBSD License"),
    "BSD-3-Clause statement": ("BSD 3-Clause", "3-Clause BSD", "Three-Clause BSD", "New BSD License", "Modified BSD", "Revised BSD"),
    "ISC statement": ("ISC License", "SPDX-License-Identifier: ISC"),
    "GPL-2.0 statement": _gnu("GPL", "GNU General Public License", "2"),
    "GPL-3.0 statement": _gnu("GPL", "GNU General Public License", "3"),
    "LGPL-2.1 statement": _gnu("LGPL", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0 statement": _gnu("LGPL", "GNU Lesser General Public License", "3"),
    "AGPL-3.0 statement": _gnu("AGPL", "GNU Affero General Public License", "3"),
    "MPL-2.0 statement": ("Mozilla Public License Version 2.0", "Mozilla Public License v. 2.0", "Mozilla Public License v2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL v2.0"),
    "EPL-2.0 statement": ("Eclipse Public License 2.0", "Eclipse Public License Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "EPL 2.0"),
    "BSL-1.0 statement": ("Boost Software License", "BSL 1.0"),
    "Zlib statement": ("zlib License", "SPDX-License-Identifier: Zlib"),
    "Unlicense statement": ("The Unlicense", "SPDX-License-Identifier: Unlicense"),
    "CC0-1.0 statement": ("CC0 1.0", "Creative Commons Zero"),
    "EUPL-1.2 statement": ("EUPL 1.2", "EUPL v1.2", "EUPL version 1.2", "European Union Public License 1.2", "European Union Public License v. 1.2",
                           "European Union Public License version 1.2"),
    **_cc("BY", "Attribution"),
    **_cc("BY-SA", "Attribution-ShareAlike", "Attribution-Share Alike"),
    **_cc("BY-NC", "Attribution-NonCommercial"),
    **_cc("BY-ND", "Attribution-NoDerivatives", "Attribution-NoDerivs"),
    **_cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    **_cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs"),
}

# A statement says nothing after one of DENIED, with only PASSED between, nor where one of OTHERWISE follows its last word.
DENIED = "not never nor neither without cannot isn't aren't wasn't weren't"
PASSED = "under the a an any of by as is are be been covered licensed licenced released distributed available published provided terms this our"
OTHERWISE = "plate plates key keys number numbers server servers fee fees"


def bands(similarity: float) -> int:
    """One-row bands so that sets of this Jaccard similarity miss all of them with a chance of ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log(1 - similarity))


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return textnum.words(data, np.array([0, len(data)]), 0, 1, textnum.ALNUM)


def _shingles(text: str) -> np.ndarray:
    return np.unique(textnum.sequences(*_words(text), WORDS)[0])


class Statements:
    """Exact runs of a few words; of overlapping ones the longest counts.

    "License" also matches "Licence". A run whose version goes on ("Apache
    2.0.55"), that is denied ("not under the MIT License"), that another thing
    follows ("license plate"), or whose bare number stands apart ("GNU GPL. 2."), is none."""

    def __init__(self, texts: dict[str, tuple[str, ...]], templates: dict[str, str]):
        said = {p: name for name in sorted(texts) for p in texts[name]}
        said |= {p.replace("License", "Licence"): name for p, name in said.items()}
        runs = {tuple(_words(p)[0].tolist()): name for p, name in said.items()}
        bare = {tuple(_words(p)[0].tolist()) for p in said if re.search(r"(?<!version) \d+$", p)}
        self.runs = sorted(((np.array(r, np.uint64), name) for r, name in runs.items()), key=lambda x: -len(x[0]))
        self.bare = [tuple(r.tolist()) in bare for r, _ in self.runs]
        self.denied, self.passed, self.otherwise = (frozenset(_words(w.replace("'", ""))[0].tolist()) for w in (DENIED.replace("n't", "n"), PASSED, OTHERWISE))
        self.short = int(_words("t")[0][0])  # what is left of n't
        self.first = np.zeros(1 << 16, bool)
        self.first[[int(r[0] >> np.uint64(48)) for r, _ in self.runs]] = True
        # templates that hold a run's words tell of them when they are found themselves
        inside = {t: set(itertools.chain(*(zip(*(w[i:] for i in range(n))) for w in [_words(text)[0].tolist()] for n in {len(r) for r, _ in self.runs})))
                  for t, text in templates.items()}
        self.told = [{t for t, of in inside.items() if tuple(r.tolist()) in of} for r, _ in self.runs]

    def _said(self, k: int, at: int, low: int, high: int, word: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether run ``k`` at word ``at`` of a document of words ``low`` to ``high`` states a license."""
        last = at + len(self.runs[k][0]) - 1
        if self.bare[k] and bytes(data[end[last - 1]:start[last]]) != b" ":
            return False
        if last + 1 < high:
            if int(word[last + 1]) in self.otherwise:
                return False
            if bytes(data[end[last]:start[last + 1]]) == b"." and bytes(data[[end[last] - 1, start[last + 1]]]).isdigit():
                return False
        return not self.denies(word, low, at)

    def denies(self, word: np.ndarray, low: int, at: int) -> bool:
        """Whether the words before ``at``, from ``low`` on, deny what follows."""
        before = at - 1
        while before >= low and int(word[before]) in self.passed:
            before -= 1
        if before > low and int(word[before]) == self.short:
            before -= 1
        return before >= low and int(word[before]) in self.denied

    def scan(self, word: np.ndarray, count: np.ndarray, data: np.ndarray, places):
        """(document, run, first word, words) of every run, by document and place;
        ``places()`` gives where each word begins and ends in ``data``."""
        may = np.flatnonzero(self.first[word >> np.uint64(48)])
        if not len(may):
            return []
        end = np.cumsum(count)
        doc = np.searchsorted(end, may, "right")
        found = []
        for k, (run, _) in enumerate(self.runs):
            here = (word[may] == run[0]) & (may + len(run) <= end[doc])
            at, of = may[here], doc[here]
            for i in range(1, len(run)):
                same = word[at + i] == run[i]
                at, of = at[same], of[same]
            found += [(d, k, p, len(run)) for d, p in zip(of.tolist(), (at - (end - count)[of]).tolist(), strict=True)]
        if not found:
            return []
        out, taken = [], set()
        start, stop = places()
        for d, k, p, n in found:  # longer ones first
            low, high = int(end[d] - count[d]), int(end[d])
            if not any((d, i) in taken for i in range(p, p + n)) and self._said(k, low + p, low, high, word, data, start, stop):
                taken.update((d, i) for i in range(p, p + n))
                out.append((d, k, p, n))
        return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.sets = [_shingles(texts[n]) for n in self.names]
        self.level = [max(0, math.ceil(math.log2(max(1, len(s))))) for s in self.sets]
        self.span = {n: 1 << k for n, k in zip(self.names, self.level, strict=True)}
        self.one_line = [len(s) <= ONE_LINE - WORDS + 1 for s in self.sets]
        # the least similarity of a template to a window that holds CONTAINMENT of it
        least = min(CONTAINMENT * len(s) / (2 * 2 ** k + (1 - CONTAINMENT) * len(s)) for s, k in zip(self.sets, self.level, strict=True))
        self.bands = bands(least)
        self.rows = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(5).integers(1 << 20, 1 << 62, self.bands)]
        self.marks = [[int(((s * r) >> np.uint64(32)).min()) for r in self.rows] for s in self.sets]

    def scan(self, shingle: np.ndarray, runs: np.ndarray):
        """(document, template, containment, first shingle, first one that is the template's) of every verified window of these documents."""
        n = len(shingle)
        if not n:
            return []
        doc = np.repeat(np.arange(len(runs)), runs)
        first = np.cumsum(runs) - runs
        place = np.arange(n) - np.repeat(first, runs)
        hits: list[np.ndarray] = []
        for b, r in enumerate(self.rows):
            low = ((shingle * r) >> np.uint64(32)).astype(np.uint32)
            owner, at = doc, place
            for level in range(max(self.level) + 1):
                if level:  # blocks of a document: two neighbours of the level below, the last may be alone
                    even = np.flatnonzero(at % 2 == 0)
                    follow = np.minimum(even + 1, len(low) - 1)
                    low = np.where(owner[follow] == owner[even], np.minimum(low[even], low[follow]), low[even])
                    owner, at = owner[even], at[even] // 2
                for t, k in enumerate(self.level):
                    if k == level:
                        block = np.flatnonzero(low == np.uint32(self.marks[t][b]))
                        if len(block):  # the block is in two windows: with the one before and the one after
                            for shift in (0, 1):
                                hits.append(np.stack([owner[block], np.full(len(block), t), np.maximum(0, at[block] - shift)], 1))
        if not hits:
            return []
        out = []
        for d, t, w in np.unique(np.concatenate(hits), axis=0).tolist():
            step = 1 << self.level[t]
            a = first[d] + w * step
            window = shingle[a:min(a + 2 * step, first[d] + runs[d])]
            share = np.isin(self.sets[t], window).mean()
            if share >= CONTAINMENT:
                out.append((d, t, float(share), w * step, w * step + int(np.isin(window, self.sets[t]).argmax())))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
         statements: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document: (doc_id, n_licenses, licenses, best, windows).

    ``licenses`` are the names of all templates and statements found, sorted
    and joined by ", "; ``best`` the greatest containment (null without any,
    1 for a statement); ``windows`` one (template, containment, first word) per
    verified window or statement. Of overlapping statements the longest is
    named, and one inside the window of a template that holds its words is not
    named again. Templates of one line, like statements, say nothing where the
    words before deny them. With other ``templates`` there are no statements but those given.

    Texts that are null, empty or without words hold none; a text of fewer
    words than a shingle is one shingle. Repeated rows and null ids give a row
    each; an empty table gives an empty result; other columns are ignored.
    """
    if statements is None:
        statements = {} if templates else STATEMENTS
    templates = templates or TEMPLATES
    sent = docs.sparkSession.sparkContext.broadcast((Templates(templates), Statements(statements, templates)))
    window = pa.struct([("template", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())])

    def run(batches):
        t, few = sent.value
        for batch in batches:
            data, offsets = textnum.text_buffers(batch.column(1))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for a, b in textnum.chunks(offsets):
                word, count = textnum.words(data, offsets, a, b, textnum.ALNUM)
                low = (np.cumsum(count) - count).tolist()
                for d, k, share, at, begin in t.scan(*textnum.sequences(word, count, WORDS)):
                    if not (t.one_line[k] and few.denies(word, low[d], low[d] + begin)):
                        found[a + d].append({"template": t.names[k], "containment": share, "first_word": at})
                spans = {d: [(w["template"], w["first_word"], w["first_word"] + 2 * t.span[w["template"]] + WORDS) for w in found[a + d]] for d in range(b - a) if found[a + d]}
                for d, k, at, n in few.scan(word, count, data, lambda a=a, b=b: textnum.places(data, offsets, a, b, textnum.ALNUM)):
                    if not any(name in few.told[k] and x < at + n and at < y for name, x, y in spans.get(d, ())):
                        found[a + d].append({"template": few.runs[k][1], "containment": 1.0, "first_word": at})
            names = [sorted({w["template"] for w in f}) for f in found]
            yield pa.record_batch([
                batch.column(0), pa.array([len(n) for n in names], pa.int64()), pa.array([", ".join(n) for n in names], pa.string()),
                pa.array([max((w["containment"] for w in f), default=None) for f in found], pa.float64()),
                pa.array(found, pa.list_(window))], names=["id", "n_licenses", "licenses", "best", "windows"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_licenses long, licenses string, best double, windows array<struct<template:string,"
                           "containment:double,first_word:long>>").withColumnRenamed("id", id_col)
