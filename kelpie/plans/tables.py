"""Logical tables derived from the physical ones, as DataFrames and as SQL for the oracle.

Clocks are frozen: AS_OF for documents and events, AS_OF_ORDERS for what derives from orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators.cut import spread

AS_OF = "2024-01-31 00:00:00"
AS_OF_ORDERS = "2001-08-02 00:00:00"
FOLDERS = ["accounts", "decisions", "weekly", "context", "saved", "research", "daily/emails", "daily/notes", "episodic", "archive"]
TIERS = ["working", "episodic", "semantic", "crystallised"]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def pick(values, key):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def path_of(key, source):
    return F.concat(F.lit("MEMORY/"), pick(FOLDERS, key), F.lit("/"), source, F.lit("_"), key.cast("string"), F.lit(".md"))


def days_before(as_of, days):
    return ntz(as_of) - F.make_dt_interval(days.cast("int"))


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memory_files(spark, sf_dir):
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return d.select(
        "doc_id", path_of(F.col("doc_id"), F.col("source")).alias("path"), F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("stem"),
        F.col("text").alias("body"), F.octet_length("text").cast("long").alias("size_bytes"), days_before(AS_OF, F.col("doc_id") % 400).alias("mtime"),
    )


MEMORY_FILES = f"""memory_files AS (
  SELECT doc_id, 'MEMORY/' || {sql_list(FOLDERS)}[doc_id % 10 + 1] || '/' || source || '_' || doc_id || '.md' AS path,
    source || '_' || doc_id AS stem, text AS body, CAST(strlen(text) AS BIGINT) AS size_bytes,
    TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 400 AS INTEGER)) AS mtime
  FROM documents)"""

_KINDS = (
    ("region", "r_regionkey", "r_name", "reg", "place"),
    ("nation", "n_nationkey", "n_name", "nat", "place"),
    ("customer", "c_custkey", "c_name", "cust", "person"),
    ("supplier", "s_suppkey", "s_name", "supp", "company"),
    ("part", "p_partkey", "p_name", "part", "product"),
)


def entities(spark, sf_dir):
    """eid, name, type, tier, base, computed, activation_count, last_activated, priority_floor, ris, sources."""
    out = None
    for table, key, name, prefix, kind in _KINDS:
        k = F.col(key).cast("long")
        d = read(spark, sf_dir, table).select(
            F.concat(F.lit(prefix + ":"), k.cast("string")).alias("eid"), F.col(name).alias("name"), k.alias("key"),
            F.when(k % 37 == 5, "decision").when(k % 41 == 7, "risk").when(k % 43 == 9, "deal").otherwise(kind).alias("type"),
        )
        out = d if out is None else out.unionByName(d)
    k = F.col("key")
    other = k % 200
    sources = F.when(k % 3 == 0, F.array(path_of(other, F.concat(F.lit("src"), (other % 20).cast("string"))))).otherwise(
        F.array(path_of(other, F.concat(F.lit("src"), (other % 20).cast("string"))), path_of((other + 7) % 200, F.concat(F.lit("src"), ((other + 7) % 200 % 20).cast("string"))))
    )
    return out.select(
        "eid", "name", "type", pick(TIERS, k).alias("tier"), (0.2 + 0.1 * (k % 8)).alias("base"), (0.3 + 0.05 * (k % 12)).alias("computed"), (k % 25).cast("int").alias("activation_count"),
        days_before(AS_OF, k % 500).alias("last_activated"), (k % 6 == 0).alias("priority_floor"), (0.01 * (k % 20)).alias("ris"), sources.alias("sources"),
    )


_PATH_SQL = f"'MEMORY/' || {sql_list(FOLDERS)}[({{0}}) % 10 + 1] || '/src' || (({{0}}) % 20) || '_' || ({{0}}) || '.md'"
ENTITIES = (
    "entities0 AS ("
    + " UNION ALL ".join(
        f"SELECT '{prefix}:' || {key} AS eid, {name} AS name, CAST({key} AS BIGINT) AS key, CASE WHEN {key} % 37 = 5 THEN 'decision' WHEN {key} % 41 = 7 THEN 'risk' WHEN {key} % 43 = 9 THEN 'deal' ELSE '{kind}' END AS type FROM {table}"
        for table, key, name, prefix, kind in _KINDS
    )
    + f"""), entities AS (
  SELECT eid, name, type, {sql_list(TIERS)}[key % 4 + 1] AS tier, CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (key % 8) AS base,
    CAST(0.3 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (key % 12) AS computed, CAST(key % 25 AS INTEGER) AS activation_count,
    TIMESTAMP '{AS_OF}' - to_days(CAST(key % 500 AS INTEGER)) AS last_activated, key % 6 = 0 AS priority_floor, CAST(0.01 AS DOUBLE) * (key % 20) AS ris,
    CASE WHEN key % 3 = 0 THEN [{_PATH_SQL.format('key % 200')}] ELSE [{_PATH_SQL.format('key % 200')}, {_PATH_SQL.format('(key % 200 + 7) % 200')}] END AS sources
  FROM entities0)"""
)


def edges(spark, sf_dir):
    """src, dst, type, weight, confidence, tier, computed, priority_floor, ris, cred, activation_count, last_activated, n_sources."""
    edge = lambda d, a, b, kind, key, weight: d.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), key.cast("long").alias("key"), weight.alias("weight"))
    eid = lambda prefix, c: F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))
    c, s, n = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    out = edge(c, eid("cust", "c_custkey"), eid("nat", "c_nationkey"), "located_at", F.col("c_custkey"), 0.3 + 0.1 * (F.col("c_custkey") % 7))
    out = out.unionByName(edge(s, eid("supp", "s_suppkey"), eid("nat", "s_nationkey"), "located_at", F.col("s_suppkey"), 0.3 + 0.1 * (F.col("s_suppkey") % 7)))
    out = out.unionByName(edge(n, eid("nat", "n_nationkey"), eid("reg", "n_regionkey"), "part_of", F.col("n_nationkey"), 0.6 + 0.0 * F.col("n_nationkey")))
    k = F.col("key")
    return out.select(
        "src", "dst", "type", "weight", (0.5 + 0.05 * (k % 10)).alias("confidence"), pick(TIERS, k).alias("tier"), (0.3 + 0.05 * (k % 12)).alias("computed"), (k % 6 == 0).alias("priority_floor"),
        (0.01 * (k % 20)).alias("ris"), (0.25 + 0.05 * (k % 16)).alias("cred"), (k % 30).cast("int").alias("activation_count"), days_before(AS_OF, k % 500).alias("last_activated"), (k % 5).cast("int").alias("n_sources"),
    )


EDGES = f"""edges0 AS (
  SELECT 'cust:' || c_custkey AS src, 'nat:' || c_nationkey AS dst, 'located_at' AS type, CAST(c_custkey AS BIGINT) AS key, CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (c_custkey % 7) AS weight FROM customer
  UNION ALL SELECT 'supp:' || s_suppkey, 'nat:' || s_nationkey, 'located_at', CAST(s_suppkey AS BIGINT), CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (s_suppkey % 7) FROM supplier
  UNION ALL SELECT 'nat:' || n_nationkey, 'reg:' || n_regionkey, 'part_of', CAST(n_nationkey AS BIGINT), CAST(0.6 AS DOUBLE) FROM nation
), edges AS (
  SELECT src, dst, type, weight, CAST(0.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (key % 10) AS confidence, {sql_list(TIERS)}[key % 4 + 1] AS tier, CAST(0.3 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (key % 12) AS computed,
    key % 6 = 0 AS priority_floor, CAST(0.01 AS DOUBLE) * (key % 20) AS ris, CAST(0.25 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (key % 16) AS cred, CAST(key % 30 AS INTEGER) AS activation_count,
    TIMESTAMP '{AS_OF}' - to_days(CAST(key % 500 AS INTEGER)) AS last_activated, CAST(key % 5 AS INTEGER) AS n_sources
  FROM edges0)"""


def triples(spark, sf_dir):
    """Incoming claims: src, dst, type, confidence, source."""
    o = read(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    k = F.col("o_custkey")
    return o.select(
        F.concat(F.lit("cust:"), k.cast("string")).alias("src"), F.concat(F.lit("nat:"), (F.col("o_orderkey") % 25).cast("string")).alias("dst"), pick(["located_at", "owns", "reports_to"], F.col("o_orderkey")).alias("type"),
        (F.pmod(F.floor("o_totalprice"), F.lit(100)) / 100.0).alias("confidence"), pick(["MEMORY/context/people_1.md", "MEMORY/daily/emails/a.md", "MEMORY/decisions/d.md"], k).alias("source"),
    ).distinct()


TRIPLES = f"""triples AS (
  SELECT DISTINCT 'cust:' || o_custkey AS src, 'nat:' || (o_orderkey % 25) AS dst, ['located_at', 'owns', 'reports_to'][o_orderkey % 3 + 1] AS type,
    (CAST(floor(o_totalprice) AS BIGINT) % 100) / CAST(100 AS DOUBLE) AS confidence, ['MEMORY/context/people_1.md', 'MEMORY/daily/emails/a.md', 'MEMORY/decisions/d.md'][o_custkey % 3 + 1] AS source
  FROM orders WHERE o_orderpriority = '1-URGENT')"""


def cost_log(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return e.select("event_id", "ts", F.to_date("ts").alias("date"), F.col("event_type").alias("model"), F.concat(F.lit("op"), (k % 5).cast("string")).alias("operation"), (F.col("value") / 1000).alias("cost_usd"))


COST_LOG = """cost_log AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS date, event_type AS model, 'op' || (coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 5) AS operation, value / 1000 AS cost_usd FROM events)"""


def proposals(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    k = F.col("conv_id")
    return c.select(
        F.concat_ws("-", k.cast("string"), F.col("turn").cast("string")).alias("uid"), F.concat(pick(["wiki/people/P", "wiki/projects/X", "wiki/decisions/D", "MEMORY/accounts/A", "MEMORY/weekly/W"], k), (k % 20).cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("reason"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), (ntz(AS_OF) - F.make_dt_interval(F.lit(0), (k % 1000).cast("int"), F.col("turn").cast("int"))).alias("ts"), pick(["pending", "accepted", "rejected"], k + F.col("turn")).alias("status"),
    )


PROPOSALS = f"""proposals AS (
  SELECT conv_id || '-' || turn AS uid, ['wiki/people/P', 'wiki/projects/X', 'wiki/decisions/D', 'MEMORY/accounts/A', 'MEMORY/weekly/W'][conv_id % 5 + 1] || (conv_id % 20) || '.md' AS path, text AS reason, 's' || (conv_id % 3) AS source,
    TIMESTAMP '{AS_OF}' - to_hours(CAST(conv_id % 1000 AS INTEGER)) - to_minutes(CAST(turn AS INTEGER)) AS ts, ['pending', 'accepted', 'rejected'][(conv_id + turn) % 3 + 1] AS status
  FROM conversations WHERE role = 'user')"""


def signals(spark, sf_dir):
    """What was read from mails: path, subject, actionable, action, urgency, confidence, deadline, already_responded."""
    c = read(spark, sf_dir, "conversations").where(F.col("role") == "user")
    k = F.col("conv_id") * 3 + F.col("turn")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")), "yyyy-MM-dd")
    return c.select(
        F.concat(F.lit("MEMORY/daily/emails/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("subject"),
        (k % 5 != 0).alias("actionable"), F.col("text").alias("action"), F.when(k % 4 != 3, pick(["high", "medium", "low"], k % 4)).alias("urgency"), (k % 10 / 10.0).alias("confidence"), F.when(k % 3 != 0, day).alias("deadline"), (k % 7 == 0).alias("already_responded"),
    )


SIGNALS = """signals AS (
  SELECT 'MEMORY/daily/emails/' || conv_id || '_' || turn || '.md' AS path, 'S' || conv_id AS subject, k % 5 <> 0 AS actionable, text AS action, CASE WHEN k % 4 <> 3 THEN ['high', 'medium', 'low'][k % 4 + 1] END AS urgency,
    k % 10 / CAST(10 AS DOUBLE) AS confidence, CASE WHEN k % 3 <> 0 THEN strftime(DATE '2024-01-01' + CAST(k % 60 AS INTEGER), '%Y-%m-%d') END AS deadline, k % 7 = 0 AS already_responded
  FROM (SELECT *, conv_id * 3 + turn AS k FROM conversations WHERE role = 'user'))"""


def calendar(spark, sf_dir):
    """Events: event_id, summary, iso, kind, urgency, is_cancelled, is_high_stakes, is_recurring, people_links, account_links."""
    e = read(spark, sf_dir, "events")
    k, u = F.col("event_id"), F.col("user_id")
    number = lambda x: F.lpad(x.cast("string"), 9, "0")
    return e.select(
        "event_id", F.concat_ws(" ", F.lit("Sync:"), "event_type", (u % 10).cast("string")).alias("summary"), F.date_format("ts", "yyyy-MM-dd").alias("iso"), pick(["external", "internal", "personal", "board"], k).alias("kind"), F.when(k % 4 != 3, pick(["high", "medium", "low"], k % 4)).alias("urgency"),
        (k % 11 == 0).alias("is_cancelled"), (k % 3 == 0).alias("is_high_stakes"), (k % 2 == 0).alias("is_recurring"), F.array(F.concat(F.lit("Customer#"), number(u)), F.lit("nobody")).alias("people_links"), F.array(F.concat(F.lit("supplier#"), number(u % 20))).alias("account_links"),
    )


CALENDAR = """calendar AS (
  SELECT event_id, 'Sync: ' || event_type || ' ' || (user_id % 10) AS summary, strftime(ts, '%Y-%m-%d') AS iso, ['external', 'internal', 'personal', 'board'][event_id % 4 + 1] AS kind, CASE WHEN event_id % 4 <> 3 THEN ['high', 'medium', 'low'][event_id % 4 + 1] END AS urgency,
    event_id % 11 = 0 AS is_cancelled, event_id % 3 = 0 AS is_high_stakes, event_id % 2 = 0 AS is_recurring, ['Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0'), 'nobody'] AS people_links, ['supplier#' || lpad(CAST(user_id % 20 AS VARCHAR), 9, '0')] AS account_links
  FROM events)"""
