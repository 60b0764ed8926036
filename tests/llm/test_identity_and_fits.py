"""Words and pretokens are told apart exactly, fits depend on rows alone, redaction is linear."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrubjay.llm import langid, minhash, mixing, secrets, textnum, token_files, toxicity
from tests.llm.frames import documents, prose
from tests.llm.test_text_operators import BYTE, SPEECH, texts

#: Two unlike strings that share every polynomial hash modulo 2 ** 64: the parity of the ones of each place, and its complement.
PARITY = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
COMPLEMENT = PARITY.translate(str.maketrans("ab", "ba"))


# -- token files --------------------------------------------------------------------------------
def library_rows(given):
    lib = Tokenizer.from_file(BYTE)
    return Counter((i, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
                   for i, t in given for ids in [lib.encode(t or "", add_special_tokens=False).ids])


def written_rows(spark, given, folder):
    files = token_files.write_token_files(documents(spark, [(i, t, None, "s") for i, t in given]), BYTE, folder, partitions=3)
    return files, Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, files).collect())


def test_pretokens_with_one_hash_get_their_own_ids(spark, tmp_dir):
    given = [(i, t) for i, t in enumerate([PARITY[:1024], COMPLEMENT[:1024], PARITY, "x " + COMPLEMENT + " y " + PARITY, COMPLEMENT, "", None])] * 2
    assert written_rows(spark, given, tmp_dir)[1] == library_rows(given)


def test_forced_collisions_of_pretokens():
    lib = Tokenizer.from_file(BYTE)
    given = texts(5)
    with open(BYTE, "rb") as f:
        enc = token_files.PretokenEncoder(f.read(), "<u2")
    real = textnum.segments
    try:
        token_files.textnum.segments = lambda v, a, b: real(v, a, b) % np.uint64(7)  # seven hashes for all pretokens
        for part in (given[:100], given[100:], given[:50]):
            assert [x.tolist() for x in enc.encode(part)] == [lib.encode(t, add_special_tokens=False).ids for t in part]
    finally:
        token_files.textnum.segments = real


def test_a_set_is_opened_again_by_its_manifest(spark, tmp_dir):
    files, rows = written_rows(spark, [(3, "some text"), (1, "more"), (None, "no id")], tmp_dir)
    again = token_files.open_token_files(tmp_dir)
    assert again == files and again.dtype == "<u2"
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, again).collect()) == rows
    assert token_files.document_ids(again, 2).tolist()[-1] == 2


def test_rows_that_share_an_id_are_dealt_to_several_parts(spark, tmp_dir):
    rng = random.Random(1)
    given = [(rng.choice([None, 7]), prose(rng, 8, tuple(f"w{k}" for k in range(90)))) for _ in range(400)]
    files, rows = written_rows(spark, given, tmp_dir)
    assert rows == library_rows(given) and len(files.parts) == 3 and max(p[1] for p in files.parts) < 300
    order = sorted(given, key=lambda g: (g[0] is not None, g[0] or 0, g[1]))
    lib = Tokenizer.from_file(BYTE)
    for k in (0, 150, 399):
        assert token_files.document_ids(files, k).tolist() == [*lib.encode(order[k][1], add_special_tokens=False).ids, 2]


# -- words ----------------------------------------------------------------------------------------
def test_unlike_words_do_not_link(spark):
    rows = [(1, PARITY, "en", "s"), (2, COMPLEMENT, "en", "s"), (3, PARITY, "en", "s"), (4, f"a b c d {PARITY} e f", "en", "s"), (5, f"a b c d {COMPLEMENT} e f", "en", "s")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_word_hashes_tell_words_of_all_lengths_apart():
    rng = random.Random(2)
    stem = "".join(rng.choices("abc", k=200))
    words = {stem[:k] for k in range(1, 200)} | {stem[:k] + "X" + stem[k + 1:n] for n in (7, 8, 9, 16, 17, 63, 64, 65, 130) for k in range(n)}
    words |= {"a\0"[:1] * k for k in range(1, 70)}
    listed = sorted(words) * 2
    raw = " ".join(listed).encode()
    data = np.frombuffer(raw, np.uint8)
    got, count, four = textnum.words(data, np.array([0, len(data)]), 0, 1, textnum.byte_classes([(0, 31), (33, 255)], lower=False), (4,))
    assert count.tolist() == [len(listed)] and len({*zip(listed, got.tolist(), strict=True)}) == len(words) == len(set(got.tolist()))
    assert len({*zip((w[:4] for w in listed), four.tolist(), strict=True)}) == len({w[:4] for w in words})
    lowered, *_ = textnum.words(np.frombuffer(raw.upper(), np.uint8), np.array([0, len(data)]), 0, 1, textnum.PLAIN)
    plain, *_ = textnum.words(np.frombuffer(raw.lower(), np.uint8), np.array([0, len(data)]), 0, 1, textnum.PLAIN)
    assert lowered.tolist() == plain.tolist()


# -- fits -----------------------------------------------------------------------------------------
def test_one_id_for_a_whole_language_is_taught(spark):
    rng = random.Random(3)
    taught = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5)
    rows = [(taught, " ".join(rng.choices(SPEECH["en"], k=20)), "en", "s") for _ in range(900)]
    rows += [(taught, "the same text again and again", "en", "s")] * 500 + [(1000 + i, " ".join(rng.choices(SPEECH["de"], k=20)), "de", "s") for i in range(300)]
    for parts in (3, 9):
        trees = langid.fit(documents(spark, rows).repartition(parts), max_docs=50)
        assert trees.langs == ["de", "en"]
        first = [trees.lengths(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in ("the water and mother", "der schön haus")]
        assert first[0][0].argmin() == 1 and first[1][0].argmin() == 0
        if parts == 9:
            assert all((a == b).all() for a, b in zip(first, before, strict=True))
        before = first
    # 50 documents of about 115 bytes each, not 1,400
    counted = sum(langid_bytes(spark, rows, 50).values())
    assert 50 * 60 < counted < 2 * 50 * 200


def langid_bytes(spark, rows, max_docs):
    """Bytes learnt by language."""
    learnt = {}
    trees = langid.Trees
    try:
        langid.Trees = lambda langs, prior, grams: learnt.update({g: int(grams[1, j][1].sum()) for j, g in enumerate(langs)})
        langid.fit(documents(spark, rows), max_docs)
    finally:
        langid.Trees = trees
    return learnt


def plain_ftrl(rows):
    """Per coordinate: rows of (buckets, label), over and over."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return (np.sign(z[i]) * toxicity.L1 - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for buckets, label in rows:
            g = 1 / (1 + np.exp(-sum(map(weight, buckets)))) - label
            for i in buckets:
                w = weight(i)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_weights_are_those_of_a_plain_loop_whatever_the_partitions(spark):
    import hashlib
    rng = random.Random(4)
    rows = [(i % 70, prose(rng, rng.randint(1, 12)) + (" idiot" if i % 70 % 3 == 0 else ""), "en", "s") for i in range(140)] + [(5, None, "en", "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(70)], "doc_id long, quality int, toxic int")
    taught = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(70) if zlib.crc32(str(i).encode()) % 3 != 1)
    wanted = []
    for _, i in taught:
        text = min((t or "" for j, t, _, _ in rows if j == i), key=lambda t: hashlib.md5(t.encode()).hexdigest())
        data = np.frombuffer(text.encode(), np.uint8)
        buckets = {int(f) for fs, _ in toxicity._grams(data, np.array([0, len(data)]), 0, 1) for f in fs} if text else set()
        wanted.append(([*sorted(buckets), 1 << toxicity.BITS], int(i % 3 == 0)))
    want = plain_ftrl(wanted)
    for parts in (1, 3, 9):
        model = toxicity.fit(documents(spark, rows).repartition(parts), labels)
        got = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True)) | {1 << toxicity.BITS: model.bias}
        assert {i: w for i, w in got.items() if w} == pytest.approx(want)


def test_reject_takes_empty_tables_and_awkward_columns(spark):
    model = toxicity.Model(0.0, np.array([3]), np.array([1.0]))
    assert toxicity.reject(documents(spark, []), model).count() == 0
    docs = documents(spark, [(1, None, "en", "s"), (None, "", "en", "s"), (2, "x" * 200_000, "en", "s")])
    kept = toxicity.reject(docs.withColumn("a`b.c", F.lit(1)), model)
    assert kept.columns == [*docs.columns, "a`b.c"] and kept.count() == 3


# -- mixing ---------------------------------------------------------------------------------------
def test_rows_without_id_spread_over_bins(spark):
    rng = random.Random(5)
    docs = documents(spark, [(None, f"row{i} " + prose(rng, 3), "en", "hot") for i in range(2000)])
    plan = {}
    real = mixing.written
    try:
        mixing.written = lambda df, tag: plan.setdefault(tag, real(df, tag))
        mixing.schedule(docs).count()
    finally:
        mixing.written = real
    keys = plan["queue"].groupBy("key").count().agg(F.max("count"), F.count("*")).first()
    assert tuple(keys) == (1, 2000)


# -- redaction --------------------------------------------------------------------------------------
def plain_redact(text, spans):
    out, at = "", 0
    for a, b in spans:
        out += text[at:a] + "[SECRET]"
        at = b
    return out + text[at:]


@pytest.mark.parametrize("chars", [7, 2048])
def test_redaction_keeps_everything_else(spark, monkeypatch, chars):
    monkeypatch.setattr(secrets, "PART_CHARS", chars)
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(40):
        pieces = [rng.choice(["é中\U0001f600 ", "plain words\n", "", "x" * rng.randint(0, 30)]) + f"AKIA{rng.randrange(10 ** 15):016}" + rng.choice([" ", "\n", "ü"]) for _ in range(rng.randint(0, 12))]
        text = "".join(pieces) + rng.choice(["", "end\U0001f600"])
        rows.append((i, text, "en", f"s{i}"))
        want[i] = plain_redact(text, [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{12,}", text)])
    got = {r["doc_id"]: r["text"] for r in secrets.redact(documents(spark, rows)).collect()}
    assert got == want


def test_redaction_is_linear(spark):
    def seconds(n):
        text = " ".join(f"AKIA{k:016} some words between" for k in range(n))
        docs = documents(spark, [(1, text, "en", "s")])
        began = time.time()
        assert secrets.redact(docs).select(F.length("text")).first()[0] == n * len("[SECRET] some words between") + n - 1
        return time.time() - began

    seconds(100)
    few, many = seconds(4000), seconds(16_000)
    assert many < 4 * few + 5
