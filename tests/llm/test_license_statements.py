"""Licenses named in a few words, and templates that must not stand for each other."""

import random

import pytest

from scrubjay.llm import licenses
from tests.llm.frames import documents, prose

SAID = [
    ("This program is licensed under the GNU General Public License, version 3", "GPL-3.0"),
    ("This article is licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("Licensed under the Apache License 2.0", "Apache-2.0"), ("distributed under the MIT License", "MIT"), ("MIT License", "MIT"),
    ("under the 3-clause BSD license", "BSD-3-Clause"), ("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("it is LGPLv3", "LGPL-3.0"),
    ("the GNU Affero General Public License, version 3", "AGPL-3.0"), ("under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
     "version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "MPL-2.0"),
]

SAID += [("released under the GNU GPL 3", "GPL-3.0"), ("the Apache Licence, version 2.0", "Apache-2.0"), ("photo: CC BY 3.0", "CC-BY-3.0"), ("text is CC-BY-SA 3.0.", "CC-BY-SA-3.0"),
         ("under the EUPL 1.2", "EUPL-1.2"), ("not only a toy: it is under the MIT License", "MIT"), ("Apache 2.0. 55 people use it", "Apache-2.0"),
         ("GNU General Public License version 3", "GPL-3.0"), ("the MIT licence", "MIT"), ("if not, see the MIT License", "MIT")]
UNSAID = ["it is not under the MIT License", "this isn't licensed under the MIT License", "server: Apache 2.0.55 (Unix)", "a FreeBSD license plate", "it runs on GNU GPL. 2. Install it",
          "never released under the GNU GPL 3", "permit license to commit under the terms", "CC BY 4.0.1"]


@pytest.mark.parametrize("around", [0, 20])
def test_words_that_state_no_license(spark, around):
    rng = random.Random(3)
    given = [(i, f"{prose(rng, around)} {s} {prose(rng, around)}".strip(), None, "s") for i, s in enumerate(UNSAID)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(documents(spark, given)).collect()}
    assert got == {i: "" for i in range(len(UNSAID))}


def test_statements_in_other_words(spark):
    rng = random.Random(1)
    given = [(i, f"{prose(rng, 40)} {s} {prose(rng, 40)}", None, "s") for i, (s, _) in enumerate(SAID)] + [(99, "permit license to commit under the terms", None, "s")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(documents(spark, given)).collect()}
    for i, (s, name) in enumerate(SAID):
        assert {x.split(" ")[0] for x in got[i].split(", ")} == {name}, s
    assert got[99] == ""


@pytest.mark.parametrize("around", [0, 30])
def test_a_template_names_its_own_license_only(spark, around):
    rng = random.Random(2)
    names = sorted(licenses.TEMPLATES)
    given = [(i, f"{prose(rng, around)} {licenses.TEMPLATES[n]} {prose(rng, around)}", None, "s") for i, n in enumerate(names)]
    got = {r["doc_id"]: r["licenses"].split(", ") for r in licenses.scan(documents(spark, given)).collect()}
    for i, n in enumerate(names):
        assert n in got[i] and {x.split(" ")[0] for x in got[i]} == {n.split(" ")[0]}
