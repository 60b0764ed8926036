"""Secret scan with corpus-wide ownership frequency (operator 1, DataFrame functions only).

Each text gives candidate spans. Their values' hashes are aggregated over the
whole corpus by distinct repositories and owners: a value met under many owners
is a copied example, one that stays with few owners and looks live is a
credential. Spans of the base kinds are always reported; the further kinds
(provider tokens, key blocks) only where they are not copied examples.

Positions come from the gaps between matches, as a running sum over one row
per match, so work stays linear in a document's length and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm.common import written

# Kinds in order, their patterns (valid in Java and RE2 alike), the group that holds
# the value, the least length of that value, and whether the kind is one of the base kinds.
KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, True),
    ("hex", r"[0-9a-f]{32,}", 0, 32, True),
    ("provider", r"(?:gh[opsu]_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20, False),
    ("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]{16,}", 0, 48, False),
]
PLACEHOLDER = r"example|sample|changeme|placeholder|dummy|your|xxxx|0000|1234"
#: A value under this many distinct owners is a copied example.
WIDE_OWNERS = 5
#: Code points of the parts that a text is cut into for redaction.
PART_CHARS = 2048
#: A live-looking value has at least this many distinct characters.
LIVE_CHARS = 8


def _match(kind: int, least: int):
    def one(z: Column, k: Column) -> Column:
        value = z["v"]
        looks = ~F.lower(value).rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS)
        return F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(z["gap"]).alias("gap"), F.length(z["m"]).alias("len"),
                        F.md5(value).alias("hash"), (F.length(value) >= least).alias("ok"), looks.alias("live"))
    return one


def _found(text: Column) -> Column:
    """Per match, in order and failing ones included: kind, place, gap before it, length, value hash, looks."""
    out = []
    for n, (_, pattern, group, least, _) in enumerate(KINDS):
        p = F.lit(pattern)
        cut = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("v"),
                           F.split(text, pattern, -1).alias("gap"))
        got = F.filter(F.transform(cut, _match(n, least)), lambda s: s["len"].isNotNull())
        out.append(F.when(text.rlike(pattern), got).otherwise(F.array().cast(FOUND)))
    return F.concat(*out)


FOUND = "array<struct<kind:int,k:int,gap:int,len:int,hash:string,ok:boolean,live:boolean>>"
#: Holds for every text in which a kind matches.
ANY = "|".join(p for _, p, *_ in KINDS)


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a match, written once, with a row number ``__row`` and ``__found``."""
    hit = docs.where(_text(docs, text_col).rlike(ANY))
    return written(hit.withColumn("__found", _found(_text(docs, text_col))).withColumn("__row", F.monotonically_increasing_id()), "secrets")


def spans(found: DataFrame, repo_col: str = "source", owner: Column | None = None, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """One row per reported span: (row, kind, start, end, value_hash, n_docs, n_repos, n_owners, verdict).

    ``start`` and ``end`` count code points, end exclusive. The owner of a
    repository is its name up to the first slash unless ``owner`` says
    otherwise; null repositories count as one. ``verdict`` is ``example`` (met
    under ``wide_owners`` owners or more), ``live`` or ``placeholder``.
    """
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    owner = F.regexp_extract(repo, "^[^/]*", 0) if owner is None else F.coalesce(owner.cast("string"), F.lit(""))
    each = found.select(F.col("__row").alias("row"), repo.alias("repo"), owner.alias("owner"), F.explode("__found").alias("s")) \
                .select("row", "repo", "owner", "s.*")
    upto = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)) \
               .withColumn("start", F.col("end") - F.col("len")).where("ok").drop("k", "gap", "len", "ok")
    # hot values collapse map-side: (hash, repository) first, then distinct repositories and owners
    by_repo = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    shared = by_owner.groupBy("hash").agg(F.sum("n").alias("n_spans"), F.sum("r").alias("n_repos"), F.count("*").alias("n_owners"))
    each = each.join(shared, "hash").withColumn(
        "verdict", F.when(F.col("n_owners") >= wide_owners, "example").when(F.col("live"), "live").otherwise("placeholder"))
    base = [n for n, k in enumerate(KINDS) if k[4]]
    return each.where(F.col("kind").isin(base) | (F.col("verdict") != "example")).select(
        "row", "kind", "start", "end", F.col("hash").alias("value_hash"), "n_spans", "n_repos", "n_owners", "verdict")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """One row per document: counts by base kind, hash of the base spans, all spans, live and example counts.

    Null and empty texts have no spans; every row of ``docs`` gives one row,
    repeated rows and null ids included; an empty table gives an empty result;
    other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(repo_col).alias("source"))
    found = candidates(docs)
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    label = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    in_order = F.sort_array(F.collect_list(F.struct("start", "kind", "end")))
    count = lambda c: F.count(F.when(c, 1))
    base = sum(k[4] for k in KINDS)
    rows = spans(found).groupBy("row").agg(
        *(count(F.col("kind") == n).alias(f"n_{k[0]}") for n, k in enumerate(KINDS) if k[4]), in_order.alias("all"),
        count(F.col("verdict") == "live").alias("n_live"), count(F.col("verdict") == "example").alias("n_example"))
    rows = rows.withColumn("base", F.array_join(F.transform(F.filter("all", lambda s: s["kind"] < base), label), ",")) \
               .withColumn("spans", F.array_join(F.transform("all", label), ","))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counts = ["n_assign", "n_access", "n_hex"]
    hits = found.select("doc_id", "__row").join(rows, F.col("__row") == F.col("row"), "left").select(
        "doc_id", *map(zero, counts), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"))
    none = docs.where(~_text(docs, "text").rlike(ANY)).select(
        "doc_id", *(F.lit(0).cast("long").alias(c) for c in counts), F.sha2(F.lit(""), 256).alias("base_sha256"),
        F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return hits.unionByName(none)


def _between(a: Column, b: Column) -> Column:
    """The text from code point ``a`` to ``b``, from the parts that hold it."""
    first, last = F.floor(a / PART_CHARS), F.floor((b - 1) / PART_CHARS)
    held = F.array_join(F.slice("__parts", (first + 1).cast("int"), F.greatest(F.lit(0), last - first + 1).cast("int")), "")
    return F.when(b > a, F.substring(held, (a - first * PART_CHARS + 1).cast("int"), (b - a).cast("int"))).otherwise("")


def redact(docs: DataFrame, text_col: str = "text", repo_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced: ``[SECRET]`` where a live or placeholder value lies, else ``[EXAMPLE]``.

    Overlapping spans become one. Rows without spans are returned as they are;
    ``length_col``, where there is one, follows the new text.
    """
    found = candidates(docs, text_col)
    seen = spans(found, repo_col)
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")) \
               .withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = seen.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                                F.min(F.col("verdict") == "example").alias("example"))
    islands = islands.withColumn("after", F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0)))
    cuts = islands.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "after", "example"))).alias("__cuts"),
                                      F.max("end").cast("int").alias("__last")).withColumnRenamed("row", "__cut_row")
    # the text in equal parts, made before the join: a span's gap is cut from the parts it touches, not from the text's start
    parts = F.regexp_extract_all(_text(found, text_col), F.lit(f"(?s).{{1,{PART_CHARS}}}"), F.lit(0))
    found = found.withColumn("__parts", parts)
    piece = lambda c: F.concat(_between(c["after"], c["start"]), F.when(c["example"], "[EXAMPLE]").otherwise("[SECRET]"))
    tail = _between(F.col("__last"), F.length(_text(found, text_col)))
    masked = F.concat(F.array_join(F.transform("__cuts", piece), ""), tail)
    same = F.col("__cuts").isNull()
    hits = found.join(cuts, F.col("__row") == F.col("__cut_row"), "left").withColumn(
        text_col, F.when(same, F.col(f"`{text_col}`")).otherwise(masked))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        hits = hits.withColumn(length_col, F.when(same, F.col(f"`{length_col}`")).otherwise(F.length(text_col).cast(kind)))
    rest = docs.where(~_text(docs, text_col).rlike(ANY))
    return rest.unionByName(hits.select(*[F.col(f"`{c}`") for c in docs.columns]))


def oracle() -> str:
    """The report in DuckDB SQL."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT row, source, {n} AS kind, unnest(range(len(regexp_extract_all(text, {quote(p)})))) AS k, "
        f"unnest(regexp_extract_all(text, {quote(p)})) AS m, unnest(regexp_extract_all(text, {quote(p)}, {g})) AS v, "
        f"unnest(list_slice(string_split_regex(text, {quote(p)}), 1, len(regexp_extract_all(text, {quote(p)})))) AS gap, {least} AS least FROM d"
        for n, (_, p, g, least, _) in enumerate(KINDS))
    names = "CASE kind " + " ".join(f"WHEN {n} THEN '{k[0]}'" for n, k in enumerate(KINDS)) + " END"
    base = sum(k[4] for k in KINDS)
    joined = f"string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
e AS ({each}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, kind ORDER BY k ROWS UNBOUNDED PRECEDING) AS stop FROM e),
c AS (SELECT row, source, kind, stop - length(m) AS start, stop, v,
        NOT regexp_matches(lower(v), '{PLACEHOLDER}') AND len(list_distinct(string_split(v, ''))) >= {LIVE_CHARS} AS live
      FROM p WHERE length(v) >= least),
f AS (SELECT v, count(DISTINCT regexp_extract(source, '^[^/]*')) AS n_owners FROM c GROUP BY v),
s AS (SELECT c.*, CASE WHEN n_owners >= {WIDE_OWNERS} THEN 'example' WHEN live THEN 'live' ELSE 'placeholder' END AS verdict
      FROM c JOIN f USING (v)),
r AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        {joined} FILTER (kind < {base}) AS base, {joined} AS spans,
        count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
      FROM s WHERE kind < {base} OR verdict <> 'example' GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN r USING (row)"""
