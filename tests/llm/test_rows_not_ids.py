"""Operators decide per row where ids repeat or are null."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from scrubjay.llm import minhash, mixing
from tests.llm.frames import documents, prose


def _texts(seed, n):
    rng = random.Random(seed)
    return [prose(rng, 60, tuple(f"w{k}x{j}" for j in range(50))) for k in range(n)]


def _left(spark, given):
    out = minhash.keep_first(documents(spark, [(i, t, "en", "s") for i, t in given]))
    return Counter((r["doc_id"], r["text"]) for r in out.collect())


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    a, b = _texts(1, 2)
    assert _left(spark, [(3, a), (5, a), (5, b)]) == Counter([(3, a), (5, b)])


def test_repeats_of_the_smallest_id_go(spark):
    a, b = _texts(2, 2)
    near = " ".join(["changed", *a.split(" ")[1:]])
    assert _left(spark, [(5, a)] * 40 + [(9, near), (7, b), (7, b)]) == Counter([(5, a), (7, b)])


def test_copies_without_id_go(spark):
    a, b, c = _texts(3, 3)
    given = [(None, a)] * 30 + [(4, a)] + [(None, b)] * 30 + [(None, c), (None, None), (None, ""), (8, None), (8, None)]
    assert _left(spark, given) == Counter([(4, a), (None, b), (None, c), (None, None), (None, ""), (8, None), (8, None)])


def test_mixed_sources_meet_their_targets_whatever_the_ids(spark):
    rng = random.Random(4)
    given = [(rng.choice([None, 7, 100 + i]), f"row{i} " + prose(rng, rng.randint(0, 80)), "en", "aaabbc"[i % 6]) for i in range(600)]
    docs = documents(spark, given)
    target = {r["source"]: r["target"] for r in mixing.schedule(docs).collect()}
    words, times = defaultdict(int), Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        words[r["source"]] += len(r["text"].split())
        times[r["text"]] += 1
    assert set(words) == set(target) and max(times.values()) <= 3
    for source, want in target.items():
        assert abs(words[source] - want) <= 41  # half a document
        # whole rounds of the source: two rows differ by one pass at most
        n = [times[t] for _, t, _, s in given if s == source]
        assert max(n) - min(n) <= 1


def test_rows_of_a_parquet_read_need_no_copy(spark, tmp_dir, monkeypatch):
    """The same mix from a Parquet read, whose rows know their places, as from a numbered frame; nothing is written but short rows."""
    rng = random.Random(5)
    given = [(rng.choice([None, 7, 100 + i]), f"row{i} " + prose(rng, rng.randint(0, 30)), "en", "aab"[i % 3]) for i in range(300)]
    documents(spark, given).repartition(3).write.parquet(f"{tmp_dir}/d")
    read = spark.read.parquet(f"{tmp_dir}/d")
    tags = []
    real = mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, tag: (tags.append((tag, "text" in df.columns)), real(df, tag))[1])
    mixed = corpus_pipeline.mix_sources(spark, read, "")
    assert mixed.columns == read.columns and tags == [("queue", False), ("sources", False)]
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
    target = {r["source"]: r["target"] for r in mixing.schedule(read).collect()}
    assert all(abs(words[s] - t) <= 16 for s, t in target.items())
