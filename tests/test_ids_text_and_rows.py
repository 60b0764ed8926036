"""Row ids under changing splits, exact text forms, row-targeted steps, dedup by hash."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scrubjay.functions.exprs import double_to_str
from scrubjay.operators import fills
from scrubjay.operators import quality as Q
from scrubjay.operators.patches import drop_rows, header_names
from scrubjay.operators import profile
from scrubjay.operators.profile import duplicate_count, repeated_rows
from scrubjay.operators.steps import apply_step
from scrubjay.plans.recipe import Recipe, Step, check
from scrubjay.plans.table import RID, Table
from scrubjay.sources.files import read_records_json, read_table_csv, reinfer_types
from scrubjay.sources.pages import slice_rows
from scrubjay.sources.rowid import with_load_order_id
from scrubjay.streaming.stream import apply_to_stream
from scrubjay.suite.base import fixture
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    yield to
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
@pytest.mark.parametrize("counted,read", [("400k", "100k"), ("100k", "400k")])
def test_load_order_ids_survive_other_splits(spark, splits, tmp_dir, kind, counted, read):
    path = f"{tmp_dir}/rows"
    spark.range(60_000).select("id", F.md5(F.col("id").cast("string")).alias("t")).repartitionByRange(2, "id") \
        .sortWithinPartitions("id").write.option("header", True).option("parquet.block.size", "200000").format(kind).save(path)
    raw = spark.read.option("header", True).format(kind).load(path)
    splits(counted)
    numbered = with_load_order_id(raw)
    splits(read)
    got = numbered.select(RID, F.col("id").cast("long").alias("id")).collect()
    assert len(got) == 60_000 and all(r[RID] == r["id"] for r in got)


def test_one_csv_file_is_many_tasks_without_line_breaks_in_fields(spark, splits, tmp_dir):
    path = f"{tmp_dir}/one"
    spark.range(60_000).select("id", F.md5(F.col("id").cast("string")).alias("t")).coalesce(1).write.option("header", True).csv(path)
    splits("200k")
    t = read_table_csv(spark, path, multiline=False)
    assert t.df.rdd.getNumPartitions() > 1
    assert t.df.where(F.col(RID) != F.col("id")).count() == 0 and t.df.count() == 60_000


def test_json_forms(spark, tmp_dir):
    lines, array, wrapped = (f"{tmp_dir}/{n}" for n in ("lines.json", "array.json", "wrapped.json"))
    open(lines, "w").write('{"a": {"b": 1}, "c": "x"}\n{"a": {"b": 2}, "c": "n/a"}\n')
    open(array, "w").write('[\n {"a": {"b": 1}, "c": "x"},\n {"a": {"b": 2}, "c": "n/a"}\n]\n')
    open(wrapped, "w").write('{"data": [{"a": {"b": 1}, "c": "x"}, {"a": {"b": 2}, "c": "n/a"}]}\n')
    for path in (lines, array, wrapped):
        got = sorted(map(tuple, read_records_json(spark, path).df.select(RID, "`a.b`", "c").collect()))
        assert got == [(0, 1, "x"), (1, 2, None)]


def test_long_integers_stay_exact(spark):
    df = spark.createDataFrame([("1234567890123456789", "99999999999999999999", "1" * 50, "1e3"),
                                ("1234567890123456788", "-1", "2", "2")], "a string, b string, c string, d string")
    out = reinfer_types(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "decimal(38,0)", "c": "string", "d": "double"}
    assert out.select("a").distinct().count() == 2


DOUBLES = [0.0005, -0.0005, 1e16, 1e-5, 1.5e-5, 1e18, -2.5e17, 0.000123, 1e15 + 7, 12345678.9, 0.5, 100.0, -3.25, 1e-4, 9.5e-4, 1e7, 123456789.25,
           0.001, 7e22, 0.0, float("nan"), float("inf"), float("-inf")]


def test_text_of_doubles_is_pythons(spark):
    t = Table(spark.createDataFrame(list(enumerate(DOUBLES)), f"{RID} long, x double"))
    text = {r[RID]: r["x"] for r in apply_step(t, "convert_type", "x", {"target": "string"}).df.collect()}
    assert [text[i] for i in range(len(DOUBLES))] == [str(x) for x in DOUBLES]
    found = apply_step(t, "filter_rows", "x", {"condition": "equals", "value": "0.0005"}).df.collect()
    assert [r[RID] for r in found] == [0]


def test_shortest_digits_of_large_doubles(spark):
    rnd = random.Random(4)
    xs = [rnd.choice([1, -1]) * rnd.uniform(1, 10) * 10 ** rnd.randint(16, 37) for _ in range(20_000)]
    xs += [rnd.uniform(1, 10) * 10 ** rnd.randint(-300, 300) for _ in range(20_000)] + [rnd.uniform(1, 10) * 10 ** rnd.randint(-6, 16) for _ in range(20_000)]
    xs += [10.0 ** k for k in range(15, 40)] + [2.0 ** k for k in range(50, 130)] + [1.9719543731971988e+18]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", double_to_str(F.col("x")).alias("t")).collect()
    assert [(str(r["x"]), r["t"]) for r in got if str(r["x"]) != r["t"]] == []


def test_casing_fix_takes_the_commonest_class(spark):
    assert Q.dominant_case("lower:3 upper:9 title:4 mixed:0") == "upper"
    assert Q.dominant_case("lower:4 upper:4 title:4 mixed:0") == "lower"
    words = ["AB", "CD", "EF", "GH", "IJ", "KL", "MN", "op", "qr", "st", "uv", "wx"]
    t = Table(spark.createDataFrame(list(enumerate(words)), f"{RID} long, w string"))
    steps = [s for s in Q.fix_steps(Q.findings(t)) if s.type == "standardize_case"]
    assert [(s.column, s.params) for s in steps] == [("w", {"case": "upper"})]


def test_fill_after_a_sort_carries_over_ranges(spark):
    rows = [(i, (i * 7919) % 9973 if i % 3 else None, float(i) if i % 11 == 0 else None) for i in range(30_000)]
    t = apply_step(Table(spark.createDataFrame(rows, f"{RID} long, k long, v double").repartition(7)), "sort_values", "k", {"direction": "desc"})
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for method, seq in (("ffill", order), ("bfill", order[::-1])):
        want, last = {}, None
        for rid, _, v in seq:
            last = v if v is not None else last
            want[rid] = last
        assert {r[RID]: r["v"] for r in apply_step(t, "fill_missing", "v", {"method": method}).df.collect()} == want


def test_title_matches_python(spark):
    words = ["中a", "中A", "ßa", "straße", "o'neil-smith 3rd", "ÉCOLE élan", "a1b", "ǆabc x", "日本語abc def", ""]
    words = [w for w in words if "ǆ" not in w]
    t = Table(spark.createDataFrame(list(enumerate(words)), f"{RID} long, w string"))
    got = {r[RID]: r["w"] for r in apply_step(t, "standardize_case", "w", {"case": "title"}).df.collect()}
    assert [got[i] for i in range(len(words))] == [w.title() for w in words]
    from scrubjay.functions.exprs import is_title
    judged = {r[RID]: r["t"] for r in t.df.select(RID, is_title(F.col("w")).alias("t")).collect()}
    assert [bool(judged[i]) for i in range(len(words))] == [w.istitle() for w in words]


def test_header_names_are_free_and_reserved_ones_refused(spark):
    assert header_names(["a", "a_1", "a", "a"]) == ["a", "a_1", "a_2", "a_3"]
    with pytest.raises(ValueError):
        header_names(["x", "_rid"])
    t = fixture(spark, SF_SMALL, "ev_dirty")
    with pytest.raises(ValueError):
        apply_step(t, "rename_column", "value", {"new_name": "__sj_x"})


def test_constant_fill_is_the_same_on_streams(spark):
    df = spark.createDataFrame([(0, None, None, None), (1, True, 2.0, "x")], f"{RID} long, b boolean, n double, s string")
    for column, value in (("b", "true"), ("n", "3"), ("s", "y")):
        step = Step("fill_missing", column, {"method": "custom", "value": value})
        static = apply_step(Table(df), step.type, step.column, step.params).df
        assert sorted(map(str, static.collect())) == sorted(map(str, apply_to_stream(df, [step]).collect()))
        assert static.where(F.col(column).isNull()).count() == 0


def test_row_checks_leave_the_table_unshuffled(spark):
    t = fixture(spark, SF_SMALL, "ev_dirty")
    few = spark.createDataFrame([(3,), (5,)], f"{RID} long")
    dropped = drop_rows(t, few)
    assert dropped.df.count() == t.df.count() - 2
    assert "hashpartitioning" not in _plan(t.df.select(RID).join(F.broadcast(few), RID, "left_semi"))
    joins = [line for line in _plan(dropped.df).split("\n") if "Join" in line]
    assert joins and all("Broadcast" in j for j in joins)
    with pytest.raises(ValueError, match="no row has id 987654321"):
        drop_rows(t, [3, 987654321])


def test_dedup_compares_rows_when_hashes_collide(spark):
    rows = [(i, "x" if i % 3 else None, float(i % 4)) for i in range(40)]
    t = Table(spark.createDataFrame(rows, f"{RID} long, a string, v double"))
    one = lambda t: F.struct(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"))  # noqa: E731  every row collides
    seen, want = set(), set()
    for i, *values in rows:
        if tuple(values) in seen:
            want.add(i)
        seen.add(tuple(values))
    assert {r[0] for r in repeated_rows(t, hashed=one).collect()} == want == {r[0] for r in repeated_rows(t).collect()}
    assert duplicate_count(t, hashed=one).first()[0] == duplicate_count(t).first()[0] == len(want)


def _operators_below(plan, line):
    """The lines of ``plan`` that stand deeper under ``line``."""
    lines = plan.split("\n")
    at = lines.index(line)
    depth = len(line) - len(line.lstrip(" :+-"))
    below = []
    for x in lines[at + 1:]:
        if len(x) - len(x.lstrip(" :+-")) <= depth:
            break
        below.append(x)
    return "\n".join(below)


def test_only_candidates_are_shuffled_whole(spark, monkeypatch):
    t = fixture(spark, SF_SMALL, "ord_dups")
    staged_columns = []
    real = profile.staged
    monkeypatch.setattr(profile, "staged", lambda df, tag="": (staged_columns.append(df.columns), real(df, tag))[1])
    kept = profile.without_repeats(t)
    assert staged_columns == [["__sj_a", "__sj_b", "__sj_first", "__sj_n"]]
    assert "hashpartitioning" not in _plan(kept)  # few hashes: a filter of the scan
    monkeypatch.setattr(profile, "BROADCAST_HASHES", 0)
    many = profile._Repeats(t, profile.row_hash)
    plan = _plan(many.alike())
    whole = [x for x in plan.split("\n") if "Exchange hashpartitioning(__sj_a" in x and "__sj_m" not in x and "o_totalprice" in _operators_below(plan, x)]
    assert whole and all("BroadcastHashJoin" in _operators_below(plan, x) for x in whole)
    assert many.hashes > 0 and many.alike().count() == 2 * many.hashes


@pytest.mark.parametrize("limit,words", [(1_000_000, 1 << 20), (0, 1 << 20), (0, 1)])
def test_dedup_by_broadcast_and_by_bloom_filter(spark, monkeypatch, limit, words):
    monkeypatch.setattr(profile, "BROADCAST_HASHES", limit)
    monkeypatch.setattr(profile, "BLOOM_WORDS", words)
    rows = [(i, "x" if i % 3 else None, float(i % 4), -0.0 if i % 2 else 0.0) for i in range(40)] + [(50 + i, f"own{i}", None, 1.0) for i in range(30)]
    t = Table(spark.createDataFrame(rows, f"{RID} long, a string, v double, z double").repartition(5))
    seen, want = set(), set()
    for i, *values in rows:
        if tuple(values) in seen:
            want.add(i)
        seen.add(tuple(values))
    one = lambda t: F.struct(F.when(F.col("v") < 2, 1).otherwise(2).cast("long").alias("a"), F.lit(2).cast("long").alias("b"))
    for hashed in (profile.row_hash, one):
        assert {r[0] for r in repeated_rows(t, hashed).collect()} == want
        assert {r[RID] for r in profile.without_repeats(t, hashed).collect()} == {r[0] for r in rows} - want
        assert profile.without_repeats(t, hashed).columns == t.df.columns
        assert duplicate_count(t, hashed).first()[0] == len(want)


def test_a_table_without_repeats_stays_as_it_is(spark):
    t = Table(spark.createDataFrame([(i, i) for i in range(9)], f"{RID} long, a long"))
    assert profile.without_repeats(t) is t.df and repeated_rows(t).count() == 0 and duplicate_count(t).first()[0] == 0
    none = Table(t.df.where("a > 100"))
    assert profile.without_repeats(none).count() == 0 and duplicate_count(none).first()[0] == 0


def test_positions_stage_only_ids(spark, monkeypatch):
    from scrubjay.sources import rowid
    kept = []
    real = rowid.staged
    monkeypatch.setattr(rowid, "staged", lambda df, tag="": (kept.append(df.columns), real(df, tag))[1])
    t = apply_step(fixture(spark, SF_SMALL, "ev_dirty"), "sort_values", "user_id", {"direction": "asc"})
    t.positions("p").count()
    assert all(not {"value", "type_case", "date_text", "user_id"} & set(c) for c in kept)


def test_fill_blocks_follow_rows_not_key_gaps(spark, monkeypatch):
    monkeypatch.setattr(fills, "MIN_BLOCK_ROWS", 50)
    monkeypatch.setattr(fills, "BLOCKS_PER_CORE", 1)
    rows = [(0 if i == 0 else 10 ** 15 + i, float(i) if i % 10 == 0 else None) for i in range(2000)]
    t = Table(spark.createDataFrame(rows, f"{RID} long, v double"))
    keyed, _ = fills._keyed(t, None)
    target = fills._target(2000, spark)
    assert keyed.groupBy("__sj_blk").count().agg(F.max("count")).first()[0] <= 2 * target
    got = {r[RID]: r["v"] for r in fills.directional_fill(t, ["v"]).df.collect()}
    assert all(got[k] == (i // 10) * 10.0 for i, (k, _) in enumerate(rows))


def test_deep_pages_come_in_order(spark):
    t = apply_step(fixture(spark, SF_SMALL, "ev_dirty"), "sort_values", "value", {"direction": "desc"})
    top = [r[RID] for r in slice_rows(t, page=4, size=50).collect()]
    deep = slice_rows(t, page=4, size=50, pos="pos", top_k_max=0).collect()
    assert [r[RID] for r in deep] == top and [r["pos"] for r in deep] == list(range(200, 250))


def test_plan_becomes_steps_and_steps_are_checked(spark):
    t = fixture(spark, SF_SMALL, "ev_dirty")
    steps = Q.fix_steps(Q.findings(t))
    assert {s.type for s in steps} >= {"fill_missing", "handle_outliers", "fix_typos"}
    assert all(check(s, t) == (True, None) for s in steps)
    r = Recipe(t)
    for s in [s for s in steps if s.type in ("fill_missing", "fix_typos")]:
        r = r.append(s)
    bad = {"no such": Step("nope"), "sort": Step("sort_values", None, {"direction": "asc"}), "missing": Step("drop_column", "absent"),
           "rename": Step("rename_column", "value"), "replace": Step("replace_value", "value", {"old": ""}), "row": Step("drop_row"),
           "parts": Step("split_datetime", "ts", {"components": []})}
    for s in bad.values():
        ok, reason = check(s, t)
        assert not ok and reason


def test_apply_reports_and_appends_once(spark):
    r, metrics = Recipe(fixture(spark, SF_SMALL, "ev_dirty")).apply(Step("trim_whitespace", "type_pad"))
    assert metrics["cells_changed"] == r.source.df.where(F.col("type_pad").rlike(r"^\s|\s$")).count() > 0
    assert r.result.columns == r.source.columns and len(r.steps) == 1
    assert not re.search("__sj_s", " ".join(r.result.df.columns))
    assert r.stage().result.df.count() == r.result.df.count()
