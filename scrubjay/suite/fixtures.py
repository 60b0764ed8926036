"""Dirty views derived from the driver tables.

The same SQL text runs in Spark (tables bound as DataFrames) and in DuckDB
(tables pre-registered as views), so both sides see identical inputs.
Table references are written ``{name}``.
"""

from __future__ import annotations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

EV_DIRTY = """
SELECT event_id AS rid, ts, user_id,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
 CASE WHEN event_id % 7 < 6 THEN NULL ELSE value END AS value_sparse,
 CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(value AS STRING) END AS num_text,
 CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN upper(event_type)
      WHEN event_id % 3 = 1 THEN concat(upper(substr(event_type, 1, 1)), substr(event_type, 2))
      ELSE event_type END AS type_case,
 CASE WHEN event_id % 4 = 0 THEN concat('  ', event_type, ' ') ELSE event_type END AS type_pad,
 CASE WHEN event_id % 50 = 0 THEN substr(event_type, 1, length(event_type) - 1) ELSE event_type END AS type_typo,
 CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS event_type,
 CASE WHEN event_id % 13 = 0 THEN 'unknown'
      WHEN event_id % 3 = 0 THEN concat(CAST(year(ts) AS STRING), '-', lpad(CAST(month(ts) AS STRING), 2, '0'), '-', lpad(CAST(day(ts) AS STRING), 2, '0'))
      WHEN event_id % 3 = 1 THEN concat(lpad(CAST(month(ts) AS STRING), 2, '0'), '/', lpad(CAST(day(ts) AS STRING), 2, '0'), '/', CAST(year(ts) AS STRING))
      ELSE concat(lpad(CAST(day(ts) + 0 AS STRING), 2, '0'), '-', lpad(CAST(month(ts) AS STRING), 2, '0'), '-', CAST(year(ts) AS STRING)) END AS date_text
FROM {events}
"""

ORD_DUPS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_orderkey * 2 AS rid FROM {orders}
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_orderkey * 2 + 1 AS rid FROM {orders} WHERE o_orderkey % 20 = 0
"""

ORD_HOLES = """
SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS price,
 CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderpriority END AS priority,
 o_orderstatus AS status, o_orderdate AS odate FROM {orders}
"""

CELL_PATCHES = """
SELECT event_id AS rid, 'value' AS col, CASE WHEN event_id % 200 = 0 THEN 'abc' ELSE CAST(event_id % 90 AS STRING) END AS new_value FROM {events} WHERE event_id % 100 = 0
UNION ALL SELECT event_id, 'event_type', 'patched' FROM {events} WHERE event_id % 250 = 0
"""

RAW_HEADER = """
SELECT event_id + 1 AS rid, CAST(event_id AS STRING) AS c0, event_type AS c1, CAST(value AS STRING) AS c2 FROM {events}
UNION ALL SELECT 0, 'id', 'kind', 'amount'
"""

_WORDS = ("warehouse", "telephone", "champagne", "butterfly", "crocodile", "submarine", "porcupine", "vegetable")

TYPO_MANY = ("SELECT rid, CASE WHEN rid % 97 = 0 THEN substr(full_word, 1, length(full_word) - 1) ELSE full_word END AS word, full_word "
             "FROM (SELECT o_orderkey AS rid, CASE o_orderkey % 8 "
             + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " END AS full_word FROM {orders})")

# Doubles from 1e-6 to 1e18, both signs and zero, exact in both engines.
EV_DOUBLES = """
SELECT event_id AS rid, CAST(CASE event_id % 12 WHEN 0 THEN CAST('0.0005' AS DOUBLE) WHEN 1 THEN CAST('-0.0005' AS DOUBLE)
  WHEN 2 THEN CAST('1e16' AS DOUBLE) WHEN 3 THEN CAST('1.5e-5' AS DOUBLE) WHEN 4 THEN CAST('0' AS DOUBLE) WHEN 5 THEN CAST('123456789.25' AS DOUBLE)
  WHEN 6 THEN CAST('1e18' AS DOUBLE) WHEN 7 THEN CAST('0.000123' AS DOUBLE) WHEN 8 THEN CAST('-2.5e17' AS DOUBLE) WHEN 9 THEN CAST('-1e-6' AS DOUBLE)
  WHEN 10 THEN CAST('1e15' AS DOUBLE) + event_id ELSE event_id / CAST('2' AS DOUBLE) END AS DOUBLE) AS x FROM {events}
"""

RAW_LONG = """
SELECT event_id AS rid, CAST(1234567890123456789 - event_id AS STRING) AS id19,
 concat('9', lpad(CAST(event_id AS STRING), 20, '0')) AS id21, concat('7', lpad(CAST(event_id AS STRING), 44, '0')) AS id45,
 concat(CAST(event_id AS STRING), '.5') AS half FROM {events}
"""

EV_TIES = """
SELECT event_id AS rid, CASE event_id % 4 WHEN 0 THEN CAST('9' AS DOUBLE) WHEN 1 THEN CAST('10' AS DOUBLE) END AS num,
 CASE event_id % 4 WHEN 2 THEN 'b' WHEN 3 THEN 'a' END AS txt, CASE WHEN event_id % 8 < 4 THEN event_id % 4 + 9 END AS whole FROM {events}
"""

RAW_DUPS = """
SELECT event_id + 1 AS rid, CAST(event_id AS STRING) AS c0, event_type AS c1, CAST(user_id AS STRING) AS c2 FROM {events}
UNION ALL SELECT 0, 'a', 'a_1', 'a'
"""

EV_UNCASED = """
SELECT event_id AS rid, CASE event_id % 5 WHEN 0 THEN '中a 中A' WHEN 1 THEN 'ßa straße' WHEN 2 THEN 'o''neil-smith 3rd'
 WHEN 3 THEN 'ÉCOLE élan' ELSE event_type END AS word FROM {events}
"""

EV_SPARSE = """
SELECT CASE WHEN event_id = 0 THEN 0 ELSE 1000000000000000 + event_id END AS rid,
 CASE WHEN event_id % 7 < 6 THEN NULL ELSE value END AS value FROM {events}
"""

FIXTURES = {"typo_many": TYPO_MANY, "ev_doubles": EV_DOUBLES, "raw_long": RAW_LONG, "ev_ties": EV_TIES, "raw_dups": RAW_DUPS,
            "ev_uncased": EV_UNCASED, "ev_sparse": EV_SPARSE, "ev_dirty": EV_DIRTY, "ord_dups": ORD_DUPS, "ord_holes": ORD_HOLES,
            "cell_patches": CELL_PATCHES, "raw_header": RAW_HEADER}


def duck(sql: str) -> str:
    """Fixture text for DuckDB: table references become the registered views."""
    return sql.format(**{t: t for t in TABLES}).replace("AS STRING", "AS VARCHAR")


def with_fixtures(query: str, *names: str) -> str:
    """Prefix a DuckDB query with the fixture CTEs it uses."""
    ctes = ",\n".join(f"{n} AS ({duck(FIXTURES[n])})" for n in names)
    body = query.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
