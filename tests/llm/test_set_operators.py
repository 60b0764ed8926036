"""Mixing, top-k, near duplicates, components and the pipeline against brute force."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrubjay.llm import bpe, covertree, langid, licenses, minhash, mixing, secrets, token_files, topk, toxicity
from scrubjay.llm.common import components, forest
from tests.llm.frames import awkward, documents, prose
from tests.llm.test_text_operators import BYTE, WORD


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_and_forest(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(70)] + [(900, 900 + i) for i in range(40)]
    edges = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = groups(1000, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    a, b = np.array(links).T
    assert forest(1000, a, b).tolist() == want
    assert components(edges.limit(0)).count() == 0


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    given = awkward(rng) + [(100 + i, prose(rng, rng.randint(1, 50)), "en", rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(300)]
    docs = documents(spark, given)
    mix = mixing.schedule(docs)
    got = mix.withColumn("taken", mixing.taken(mix)).collect()
    assert len(got) == len(given)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in got)
    names = sorted(x for x in by if x is not None) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    target, open_, left = {}, set(names), float(total)
    while open_:  # fill by weight, stop full sources, share what they leave
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        for s in full or open_:
            target[s] = min(3.0 * size[s], weight[s] * level)
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    for s in names:
        assert by[s][0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= 1
    again = mixing.schedule(docs)
    assert sorted(map(str, again.drop("queue").collect())) == sorted(map(str, mix.drop("queue").collect()))
    # a document's passes follow each other by one round of its source
    queue = next(r["queue"] for r in got if len(r["queue"]) > 1)
    assert queue[0]["virtual_finish"] < queue[1]["virtual_finish"] and queue[0]["pass"] == 0


def test_mixing_cuts_hot_sources_into_bins(spark, monkeypatch):
    rng = random.Random(3)
    docs = documents(spark, [(i, prose(rng, rng.randint(0, 9)), None, "hot" if i % 3 else "b") for i in range(400)])
    whole = sorted(map(str, mixing.schedule(docs).collect()))
    monkeypatch.setattr(mixing, "BIN_ROWS", 7)
    assert sorted(map(str, mixing.schedule(docs).collect())) == whole


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, 1.0, "k", 5) for i, v in rows], "vec_id long, embedding array<float>, label int, score double, key string, n long")


def cloud(rng, n, d=8):
    out = [(i, [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    out += [(n + i, out[i][1]) for i in range(15)] + [(2 * n + i, [x + 0.05 * float(y) for x, y in zip(out[3][1], rng.normal(size=d), strict=True)]) for i in range(120)]
    out += [(9000, None), (9001, []), (9002, [0.0] * d), (9003, [float("nan")] * d), (9004, [float("inf")] + [0.0] * (d - 1)),
            (9005, [None] + [1.0] * (d - 1)), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (20, out[5][1]), (20, out[5][1])]
    return out


def test_topk_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rows = cloud(np.random.default_rng(1), 200)
    got = sorted(tuple(r) for r in topk.search(vectors(spark, rows), F.col("id") % 20 == 0, k=6).collect())
    ok = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows
          if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(ok):
        if i % 20 == 0:
            scored = sorted((-int(q @ v), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))[:6]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    assert got == sorted(want)
    # an id on three rows asks three times, each time with a list of its own
    assert len([g for g in got if g[0] == 20]) == 18


def test_topk_sql_is_by_rows(spark):
    import duckdb
    rng = np.random.default_rng(8)
    rows = cloud(rng, 60)[:-2] + [(40, [float(x) for x in rng.normal(size=8)]), *[(7, [0.5] * 8)] * 30, *[(20, [9.0] * 8)] * 25]
    got = topk.search(vectors(spark, rows), F.col("id") % 20 == 0).collect()
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841  the table of the SQL
    want = duckdb.sql(topk.ORACLE).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 20 * 25
    assert len([r for r in got if r["query_id"] == r["vec_id"] == 20]) >= 20 * 25  # rows of the query's id, but itself


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 64)) * 30
    for s in topk.SEGMENTS:
        m = topk._statistics(x, s)
        assert (m @ m.T >= x @ x.T - 1e-6).all()


@pytest.mark.parametrize("block", [30, 4096])
def test_covertree_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rows = cloud(np.random.default_rng(3), 150) + [(None, [5.0] + [0.0] * 7), (None, [5.0, 0.01] + [0.0] * 6)]
    got = sorted((tuple(r) for r in covertree.link(vectors(spark, rows)).collect()), key=str)
    n = len(rows)
    vec = [np.array(v, np.float32).astype(float) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for _, v in rows]
    links = [(a, b) for a in range(n) for b in range(a) if vec[a] is not None and vec[b] is not None and len(vec[a]) == len(vec[b])
             and vec[a] @ vec[b] / (np.linalg.norm(vec[a]) * np.linalg.norm(vec[b])) >= 0.9]
    root = groups(n, links)
    least = {g: min((rows[i][0] for i in range(n) if root[i] == g and rows[i][0] is not None), default=None) for g in set(root)}
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = [(rows[i][0], count[i], least[root[i]], rows[i][0] is not None and rows[i][0] == least[root[i]]) for i in range(n)]
    assert got == sorted(want, key=str)


def test_a_dense_cluster_is_accepted_whole():
    rng = np.random.default_rng(4)
    points = np.ones(16) + 0.01 * rng.normal(size=(300, 16))
    tree = covertree.CoverTree(points, np.full(300, 2), np.array([f"{i:03}" for i in range(300)])).prepare()
    found = covertree.Traversal(tree, tree, 0.9)
    assert (found.links == 2 * 299).all() and (found.root == 0).all()


def near_rows(rng):
    rows = awkward(rng)
    for g in range(12):
        base = prose(rng, rng.randint(30, 120), tuple(f"w{rng.randrange(400)}" for _ in range(60))).split(" ")
        for k in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(50)}"
            rows.append((1000 + 20 * g + k, " ".join(copy), "en", "s"))
    shared = prose(rng, 25)
    rows += [(5000 + i, prose(rng, 20, tuple(f"u{i}x{j}" for j in range(30))) + " " + shared, "en", "s") for i in range(30)]
    return rows + [(20, "just four words here", "en", "s"), (21, "Just four WORDS here", "en", "s")]


@pytest.mark.parametrize("unit,part", [(1024, 512), (4, 3)])
def test_minhash_is_brute_force(spark, monkeypatch, unit, part):
    monkeypatch.setattr(minhash, "UNIT", unit)
    monkeypatch.setattr(minhash, "PART", part)
    rows = near_rows(random.Random(7))
    got = sorted((tuple(r) for r in minhash.link(documents(spark, rows)).collect()), key=str)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for _, t, _, _ in rows]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    n = len(rows)
    links = [(a, b) for a in range(n) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = groups(n, links)
    least = {g: min((rows[i][0] for i in range(n) if root[i] == g and rows[i][0] is not None), default=None) for g in set(root)}
    want = [(rows[i][0], len(sets[i]), least[root[i]], rows[i][0] is not None and rows[i][0] == least[root[i]]) for i in range(n)]
    assert got == sorted(want, key=str)


def test_keep_first_leaves_one_of_each_group(spark):
    docs = documents(spark, near_rows(random.Random(8)))
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    table = {r["doc_id"]: r for r in minhash.link(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in table.items() if r["kept"] or i is None}


def _operators(spark):
    labels = spark.createDataFrame([(5, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    return {
        "secrets": secrets.report, "redact": secrets.redact, "licenses": licenses.scan, "langid": lambda d: langid.predict(d, langid.fit(d)),
        "mixing": mixing.schedule, "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)), "minhash": minhash.link,
        "bpe": lambda d: bpe.encode_decode(d, WORD), "tokens": lambda d: token_files.read_token_files(
            spark, token_files.write_token_files(d, BYTE, corpus_pipeline.scratch_path(spark, "test"))),
    }


OPERATORS = ["secrets", "redact", "licenses", "langid", "mixing", "toxicity", "minhash", "bpe", "tokens"]


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_give_a_row_each(spark, name):
    rows = awkward(random.Random(9))
    out = _operators(spark)[name](documents(spark, rows)).select("doc_id").collect()
    assert sorted((r["doc_id"] for r in out), key=str) == sorted((r[0] for r in rows), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, name):
    assert _operators(spark)[name](documents(spark, [])).count() == 0


def test_empty_vectors_table(spark):
    none = vectors(spark, [])
    assert covertree.link(none).count() == 0 and topk.search(none, F.col("id") % 20 == 0).count() == 0
    assert covertree.link(vectors(spark, [(1, None), (2, [0.0])])).count() == 2


def test_pipeline_stages(spark, tmp_dir):
    rng = random.Random(10)
    rows = near_rows(rng) + [(7000, "my token = \"Ab12Cd34Ef56Gh78\" " + prose(rng, 30), "en", "s")]
    rows = [(i, t, g, s if k % 3 else f"s{k % 7}") for k, (i, t, g, s) in enumerate(rows)]
    docs = documents(spark, rows)
    spark.createDataFrame([(1000, 0, 0), (5001, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "secrets", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, tmp_dir)
        if name != "bpe":
            assert out.columns == before.columns
        out.write.parquet(f"{tmp_dir}/{name}")
        docs = spark.read.parquet(f"{tmp_dir}/{name}")
        if name == "toxicity":
            assert docs.count() == len(rows)  # nothing toxic is known
        if name == "near_copies":
            kept = {r["doc_id"] for r in docs.collect()}
        if name == "secrets":
            text = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert text[7000].startswith("my [SECRET]") and "Ab12" not in text[7000] and set(text) == kept
        if name == "mixing":
            copies = defaultdict(int)
            for r in docs.collect():
                copies[r["doc_id"]] += 1
                assert r["text"] == text[r["doc_id"]]
            assert max(copies.values()) <= 3 and copies[7000] >= 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() == sum(copies.values())
    assert corpus_pipeline.run(spark, tmp_dir).count() == sum(copies.values())
