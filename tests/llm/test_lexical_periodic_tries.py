"""Lexical search, periodic runs and exact dedup against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scrubjay.llm import lexical, periodic, tries
from tests.llm.frames import awkward, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM, WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- exact dedup --------------------------------------------------------------------------------
def copies(rng):
    rows = awkward(rng)
    stem = "common beginning of many texts, "
    for g in range(60):
        text = stem * rng.randint(0, 3) + prose(rng, rng.randint(0, 12), ("a", "Ab", "abc", "é", "É"))
        rows += [(rng.choice([None, 100 + rng.randrange(400), 100 + rng.randrange(400)]), rng.choice([text, text.upper(), text.lower()]), "en", "s")
                 for _ in range(rng.choice([1, 1, 2, 5]))]
    return rows + [(7000 + i % 90, "the hot text " * 30, "en", "s") for i in range(200)] + [(i, t, "en", "s") for i, t in ((1, ""), (2, None), (2, ""))]


def plain_dedup(rows, pick):
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = pick((i for i in ids if i is not None), default=None)
        want[keep, keep, len(ids), True, sha(text)] += 1  # of repeated rows one stays
        for i, n in Counter(ids).items():
            want[i, keep, len(ids), False, sha(text)] += n - (i == keep)
    return +want


@pytest.mark.parametrize("spill,largest", [(None, True), (None, False), (3000, True), (600, False)])
def test_exact_dedup_is_a_dictionary(spark, spill, largest):
    rows = copies(random.Random(1))
    got = Counter(tuple(r) for r in tries.dedup(documents(spark, rows).repartition(5), largest=largest, spill_bytes=spill).collect())
    assert got == plain_dedup(rows, max if largest else min)


def test_subtrees_are_cut_and_never_lose_a_text():
    rng = random.Random(2)
    texts = [("ab" * rng.randint(0, 6) + rng.choice(["", "c", "cd", "\xff"]) * rng.randint(0, 3)).encode() for _ in range(2000)]
    trie, out = tries.PatriciaTrie(), []
    for k, t in enumerate(texts):
        e = tries.Entry(k, k, 1, [k])
        if not trie.insert(t, e):
            out.append((t, e))
        while trie.bytes > 4000 and trie.terminals > 1:
            out += trie.cut_heaviest()
        assert trie.bytes >= 0
    inside = list(trie.entries())
    assert out and inside and trie.bytes <= 4000
    assert sorted(m for e in [*inside, *(e for _, e in out)] for m in e.members) == list(range(2000))
    assert all(texts[m] == t for t, e in out for m in e.members)
    assert not {texts[m] for e in inside for m in e.members} & {t for t, _ in out}  # a text lies inside or below a cut, not both
    assert all(len({texts[m] for m in e.members}) == 1 for e in inside)


def test_a_text_beyond_the_limit_stays_whole(spark):
    rows = [(i, "x" * 5000 + str(i % 3), "en", "s") for i in range(9)]
    got = Counter(tuple(r) for r in tries.dedup(documents(spark, rows), spill_bytes=1000).collect())
    assert got == plain_dedup(rows, max)


# -- periodic runs ------------------------------------------------------------------------------
def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        x = 0
        while x + q < len(w):
            a = x
            while x + q < len(w) and w[x] == w[x + q]:
                x += 1
            if x - a + q >= max(6, 4 * q) and x > a:
                seg = w[a:x + q]
                if all(seg[k:] != seg[:-k] for k in range(1, q)):
                    out.append((a, len(seg), q))
            x += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(w):
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


def repeats(rng, n):
    w, kinds = [], rng.choice([1, 2, 3, 5, 60])
    while len(w) < n:
        unit = [f"w{rng.randrange(kinds)}é" for _ in range(rng.randint(1, 40))]
        w += (unit * rng.randint(1, 9))[:rng.randint(1, 150)] if rng.random() < 0.6 else unit
    return w


DIGEST = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_are_those_of_a_plain_search(spark):
    rng = random.Random(3)
    rows = awkward(rng)[:8] + [(20 + i, rng.choice([" ", "\n\t ", "\x0b"]).join(repeats(rng, rng.randint(1, 250))), None, "s") for i in range(150)]
    rows += [(None, "a " * 7, None, "s"), (9, "\x85 \x1c" * 30, None, "s"), (9, "a b " * 40 + "c " * 50 + "a", None, "s")]
    got = Counter(tuple(r) for r in periodic.detect(documents(spark, rows), DIGEST).collect())
    assert got == Counter((i, *plain_report(WORD.findall(t or ""))) for i, t, _, _ in rows)
    whole = periodic.detect(documents(spark, [(1, " x  x x x x\nx y", None, "s")]), ("runs", "collapsed")).collect()[0]
    assert [tuple(r) for r in whole["runs"]] == [(0, 6, 1)] and whole["collapsed"] == "x y"


def test_blocks_do_not_change_runs(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(repeats(rng, rng.randint(0, 300))).encode() for _ in range(60)]
    whole = [r for _, r in periodic._of_documents(texts)]
    monkeypatch.setattr(periodic, "BLOCK_WORDS", 50)
    assert [r for _, r in periodic._of_documents(texts)] == whole


@pytest.mark.parametrize("unit", [1, 7, 1000, 4999])
def test_long_periods_in_a_long_document(unit):
    rng = random.Random(unit)
    part = [str(rng.randrange(500)).encode() for _ in range(unit)]
    words = [b"start"] * 3 + (part * 20_000)[:20_000]
    runs = dict((r[2], r) for r in next(periodic._of_documents([b" ".join(words)]))[1])
    assert runs[unit][0] <= 3 and runs[unit][1] >= 20_000 and max(runs) == unit


def test_equal_words_of_different_documents_do_not_join():
    found = list(periodic._of_documents([b"a a a", b"a a a a", b"", b"a a a a a a"]))
    assert [r for _, r in found] == [[], [], [], [(0, 6, 1)]]


def test_repeated_tails_are_made_as_stated(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["  ", "\n"]).join(repeats(rng, rng.randint(1, 60))), None, "s") for i in range(300)] + [(None, "a b", None, "s"), (3, "", None, "s")]
    docs = documents(spark, rows)
    out = docs.select("doc_id", periodic.repeated_tail(docs.doc_id, docs.text).alias("t"))
    want = Counter()
    for i, t, _, _ in rows:
        w = WORD.findall(t)
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        want[i, tuple(w)] += 1
    assert Counter((r["doc_id"], tuple(WORD.findall(r["t"]))) for r in out.collect()) == want


# -- lexical search -----------------------------------------------------------------------------
def plain_search(rows, items, k):
    words = [TERM.findall((t or "").translate(LOWER)) for _, t, _, _ in rows]
    n_docs, total = sum(map(bool, words)), sum(map(len, words))
    tf = [Counter(w) for w in words]
    df = Counter(t for c in tf for t in c)
    want = []
    for item, text in items:
        scored = []
        for at, (i, _, _, _) in enumerate(rows):
            m = 50 + (50 * len(words[at]) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[at][t]) // (1000 * tf[at][t] + 20 * m))
                    for t in set(TERM.findall((text or "").translate(LOWER))) if t in tf[at])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        want += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return Counter(want)


def library(rng):
    vocab = tuple(f"t{int(rng.paretovariate(0.7))}" for _ in range(400))
    rows = awkward(rng) + [(100 + i, prose(rng, rng.randint(0, 60), vocab), "en", "s") for i in range(260)]
    rows += [(rng.choice([None, 5, 6]), prose(rng, 12, vocab), "en", "s") for _ in range(20)]
    items = [(i, prose(rng, rng.randint(1, 25), vocab)) for i in range(25)]
    items += [(3, rows[40][1]), (None, "t1 T1-t2"), (30, None), (31, ""), (32, "?!"), (33, "nowhere"), (34, rows[50][1]), (34, rows[50][1])]
    return rows, items


@pytest.mark.parametrize("k,lot,bounds", [(50, None, lexical.BOUNDS), (5, None, (0.01, 0.05, 0.2)), (5, 60, (0.03,)), (400, None, lexical.BOUNDS)])
def test_search_is_brute_force(spark, monkeypatch, k, lot, bounds):
    monkeypatch.setattr(lexical, "BOUNDS", bounds)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 40)
    rows, items = library(random.Random(6))
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, block int")
    got = lexical.search(documents(spark, rows).repartition(3), asked, k, lot_terms=lot)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain_search(rows, items, k)


def test_floors_prune_and_keep_ties(spark, monkeypatch):
    """Many equal documents at the floor: the smallest ids win though all were kept."""
    rows = [(i, "rare common" if i % 2 else "common other", "en", "s") for i in range(120, 0, -1)] + [(200 + i, "word", "en", "s") for i in range(50)]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "BOUNDS", (0.4,))
    items = [(1, "rare common"), (2, "common"), (3, "word other")]
    got = lexical.search(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert Counter(tuple(r) for r in got.collect()) == plain_search(rows, items, 7)


def test_what_later_stages_can_add():
    lot = lexical.Lot(np.array([1, 1, 1, 2]), np.array([0, 1, 2, 0]), np.array([0, 1, 2, 0]), np.array([5, 3, 1, 5]), np.array([10, 10, 10, 10]), 3)
    assert lot.later == {1: [90, 40, 10, 0], 2: [50, 0, 0, 0]}
    assert lot.terms[1] == {1: [(1, 3)]}


def test_empty_tables(spark):
    none, items = documents(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert tries.dedup(none).count() == 0 and periodic.detect(none).count() == 0
    assert lexical.search(none, items).count() == 0
    assert lexical.search(documents(spark, awkward(random.Random(7))), items.limit(0)).count() == 0


def test_a_row_for_each_awkward_row(spark):
    rows = awkward(random.Random(8))
    ids = sorted((r[0] for r in rows), key=str)
    for out in (tries.dedup(documents(spark, rows)), periodic.detect(documents(spark, rows))):
        assert sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=str) == ids
