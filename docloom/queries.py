"""Queries by name, over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.identity import derived_uuid
from docloom.functions.text_analysis import STOP_WORDS
from docloom.operators import history, merge, search
from docloom.session import SPACE, Engine
from docloom.sources.store import shared_folder
from docloom.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Fixed values of the queries below: query vectors, search texts, instants.
NOW = "2024-01-20 12:00:00"
TERMS = "worthless thereation license"


def vector(seed: int, n: int = 64) -> list[float]:
    return [((i * 37 + seed * 11) % 17 - 8) / 8.0 for i in range(n)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, *names: str, **ids: str) -> Engine:
    e = Engine(spark)
    for n in names:
        e.register(n, table(spark, sf_dir, n), ids.get(n))
    return e


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


def sql_query(name: str, tables: str, text: str, oracle: str | None = None, **ids: str) -> None:
    """A statement of the dialect over native tables; the oracle is the same text unless given."""
    query(name, oracle or text)(lambda spark, sf_dir: engine(spark, sf_dir, *tables.split(), **ids).sql(text))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


# ---- scans, predicates, expressions

sql_query("flagship", "orders", "SELECT o_orderpriority, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 5")
sql_query("scan_filter_project", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'N'")
sql_query("key_lookup", "orders", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 7, 500, 1234)")
sql_query("range_lookup", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 300 OR o_orderkey > 14900")
sql_query("star_projection", "nation", "SELECT * FROM nation")
sql_query("single_row", "region", "SELECT 1 + 2 * 3 AS n, 'it''s' AS s, 7 / 2 AS q, NULL AS nothing", "SELECT CAST(7 AS BIGINT) AS n, 'it''s' AS s, CAST(3 AS BIGINT) AS q, CAST(NULL AS VARCHAR) AS nothing")
sql_query("like_ilike_in_between", "part", "SELECT p_partkey, p_name FROM part WHERE (p_name LIKE '%a%' OR p_name ILIKE '%B_A%') AND p_size IN (1, 5, 9, 13, 20, 30) AND p_retailprice BETWEEN 900 AND 1800 AND p_type NOT LIKE '%XX\\%'")
sql_query(
    "null_and_not_two_valued", "nation",
    "SELECT n_nationkey, CASE WHEN NOT (n_name = NULL) THEN 1 ELSE 0 END AS a FROM nation WHERE NOT (CASE WHEN n_regionkey > 2 THEN n_regionkey END = 3)",
    "SELECT n_nationkey, 1 AS a FROM nation WHERE NOT coalesce(CASE WHEN n_regionkey > 2 THEN n_regionkey END = 3, false)",
)
sql_query(
    "case_coalesce_arith", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS d, l_extendedprice * (1 - l_discount) AS net, l_linenumber / (l_linenumber - 1) AS z, CASE l_returnflag WHEN 'A' THEN 'ret' WHEN 'N' THEN 'new' ELSE 'other' END AS f, COALESCE(CASE WHEN l_quantity > 25 THEN l_linenumber END, -1) AS c FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS d, l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_linenumber > 1 THEN l_linenumber // (l_linenumber - 1) END AS z, CASE l_returnflag WHEN 'A' THEN 'ret' WHEN 'N' THEN 'new' ELSE 'other' END AS f, coalesce(CASE WHEN l_quantity > 25 THEN l_linenumber END, -1) AS c FROM lineitem",
)
sql_query("type_mismatch", "orders", "SELECT COUNT(*) AS n FROM orders WHERE o_orderkey <> 'x' AND NOT (o_orderkey = 'x') AND NOT (o_orderstatus < 5)", "SELECT count(*) AS n FROM orders")
query("parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O' AND o_orderpriority LIKE '1%'")(lambda s, d: engine(s, d, "orders").sql("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ? AND o_orderpriority LIKE ?", [200000, "O", "1%"]))
sql_query("distinct_rows", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql_query("distinct_order_limit", "orders", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority DESC LIMIT 3")

# ---- aggregation, order, paging

sql_query("group_by_aggs", "lineitem", "SELECT l_returnflag AS flag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS lines, SUM(l_quantity) AS qty, AVG(l_extendedprice) AS avg_price, MIN(l_shipdate) AS first_ship, MAX(l_discount) AS top_discount FROM lineitem GROUP BY flag, l_linestatus", "SELECT l_returnflag AS flag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, sum(l_quantity) AS qty, avg(l_extendedprice) AS avg_price, min(l_shipdate) AS first_ship, max(l_discount) AS top_discount FROM lineitem GROUP BY 1, 2")
sql_query("global_agg", "lineitem", "SELECT COUNT(*) AS n, SUM(l_quantity) + 1 AS s, AVG(l_tax) AS a, MIN(l_returnflag) AS lo, MAX(l_orderkey) AS hi FROM lineitem WHERE l_quantity < 10 LIMIT 0", "SELECT count(*) AS n, sum(l_quantity) + 1 AS s, avg(l_tax) AS a, min(l_returnflag) AS lo, max(l_orderkey) AS hi FROM lineitem WHERE l_quantity < 10")
sql_query("empty_agg", "orders", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_totalprice) AS a FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(NULL AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS a FROM orders WHERE o_orderkey < 0")
sql_query("group_order_by_aggregate", "orders", "SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 25")
sql_query("topk_order_limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
sql_query("order_by_expression", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS off FROM lineitem ORDER BY off DESC, l_orderkey, l_linenumber LIMIT 15")


@query("keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 500 AND c_acctbal >= 0 ORDER BY c_custkey LIMIT 40")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "customer", customer="c_custkey").page("SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0", 40, 500)[0]


# ---- joins and views

sql_query("inner_join_equi", "orders customer nation", "SELECT n.n_name AS nation, COUNT(*) AS n, SUM(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F' GROUP BY nation", "SELECT n.n_name AS nation, count(*) AS n, sum(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F' GROUP BY 1")
sql_query("inner_join_theta", "nation region", "SELECT n.n_name AS n, r.r_name AS r FROM nation n INNER JOIN region r ON n.n_regionkey < r.r_regionkey AND n.n_nationkey > 3 ORDER BY n.n_nationkey, r.r_regionkey")


@query("virtual_view", "SELECT o_orderpriority, count(*) AS n FROM (SELECT o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O') WHERE o_totalprice > 100000 GROUP BY 1")
def virtual_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    e.sql("CREATE VIRTUAL VIEW open_orders AS SELECT o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
    return e.sql("SELECT o_orderpriority, COUNT(*) AS n FROM open_orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")


# ---- documents: implicit arrays, missing, mixed types


def order_documents(spark: SparkSession, sf_dir: str, typed: bool) -> Engine:
    """Orders with their lines nested: as native nested columns (the fast way) or as JSON text."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    docs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    e = Engine(spark)
    if typed:
        e.register("orders", docs, "o_orderkey")
    else:
        e.register("orders", docs.select(F.col("o_orderkey").alias("_id"), F.to_json(F.struct("*")).alias("_doc")), "_id", "_doc")
    return e


QTY = "SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 GROUP BY l_orderkey"
query("json_path_any", f"SELECT o_orderkey FROM orders WHERE o_orderkey IN ({QTY})")(lambda s, d: order_documents(s, d, True).sql("SELECT o_orderkey FROM orders WHERE items.l_quantity > 49"))
query("json_path_any_dynamic", f"SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN ({QTY})")(lambda s, d: order_documents(s, d, False).sql("SELECT _id AS id, o_orderstatus AS status FROM orders WHERE items.l_quantity > 49"))
query("json_path_not_any", f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")(lambda s, d: order_documents(s, d, True).sql("SELECT o_orderkey FROM orders WHERE NOT (items.l_returnflag = 'R')"))
query("array_contains_all_any", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (3, 5))")(lambda s, d: order_documents(s, d, True).sql("SELECT o_orderkey FROM orders WHERE ARRAY_CONTAINS(items.l_returnflag, 'R', 'A') AND ARRAY_CONTAINS_ANY(items.l_linenumber, 3, 5)"))
query("array_length", "SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")(lambda s, d: order_documents(s, d, True).sql("SELECT o_orderkey, ARRAY_LENGTH(items) AS n FROM orders"))
query("all_values", "SELECT o_orderkey AS _id, '[' || coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber), '') || ']' AS v, '[' || coalesce(string_agg('\"' || l_returnflag || '\"', ',' ORDER BY l_linenumber, l_quantity, l_returnflag), '') || ']' AS flags FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")(lambda s, d: order_documents(s, d, False).sql("SELECT _id, ALL_VALUES(items.l_linenumber) AS v, ALL_VALUES(items.l_returnflag) AS flags FROM orders"))


def mixed_documents(spark: SparkSession, sf_dir: str) -> Engine:
    """Customers whose x is by turns whole, real, text, boolean, null, absent or an array."""
    k = F.col("c_custkey")
    x = F.when(k % 7 == 0, k.cast("string")).when(k % 7 == 1, (k.cast("double") + 0.5).cast("string")).when(k % 7 == 2, F.concat(F.lit('"s'), k, F.lit('"'))).when(k % 7 == 3, F.lit("true")).when(k % 7 == 4, F.lit("null")).when(k % 7 == 6, F.concat(F.lit("["), k, F.lit(',"z"]')))
    doc = F.concat(F.lit('{"k":'), k, F.coalesce(F.concat(F.lit(',"x":'), x), F.lit("")), F.lit("}"))
    e = Engine(spark)
    e.register("mixed", table(spark, sf_dir, "customer").select(k.alias("_id"), doc.alias("_doc")), "_id", "_doc")
    return e


query("json_missing_exists", "SELECT c_custkey AS id, c_custkey % 7 <> 5 AS there, c_custkey % 7 IN (4, 5) AS empty FROM customer WHERE c_custkey % 7 >= 4")(lambda s, d: mixed_documents(s, d).sql("SELECT _id AS id, EXISTS(x) AS there, x IS NULL AS empty FROM mixed WHERE x IS MISSING OR x IS NULL OR ARRAY_LENGTH(x) = 2"))
query("mixed_compare", "SELECT c_custkey AS id FROM customer WHERE (c_custkey % 7 IN (0, 6) AND c_custkey > 700) OR (c_custkey % 7 = 1 AND c_custkey + 0.5 > 700) OR (c_custkey % 7 = 2 AND 's' || c_custkey = 's65')")(lambda s, d: mixed_documents(s, d).sql("SELECT _id AS id FROM mixed WHERE x > 700 OR x = 's65'"))
query("minmax_mixed_types", "SELECT count(*) FILTER (c_custkey % 7 NOT IN (4, 5)) AS n, (SELECT CAST(least(min(c_custkey), 1) AS VARCHAR) FROM customer WHERE c_custkey % 7 = 0) AS lo, (SELECT '[' || max(CAST(c_custkey AS VARCHAR)) || ',\"z\"]' FROM customer WHERE c_custkey % 7 = 6) AS hi, sum(CASE c_custkey % 7 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 0.5 WHEN 3 THEN 1 END)::DOUBLE AS s FROM customer")(lambda s, d: mixed_documents(s, d).sql("SELECT COUNT(x) AS n, MIN(x) AS lo, MAX(x) AS hi, SUM(x) AS s FROM mixed").withColumn("s", F.col("s").cast("double")))
query("mixed_order", "SELECT c_custkey AS id FROM customer ORDER BY CASE WHEN c_custkey % 7 IN (4, 5) THEN 0 WHEN c_custkey % 7 IN (0, 1, 3) THEN 1 WHEN c_custkey % 7 = 2 THEN 2 ELSE 3 END, CASE c_custkey % 7 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 0.5 WHEN 3 THEN 1 END, CASE c_custkey % 7 WHEN 2 THEN 's' || c_custkey WHEN 6 THEN '[' || c_custkey || ',\"z\"]' END, c_custkey")(lambda s, d: mixed_documents(s, d).sql("SELECT _id AS id FROM mixed ORDER BY x"))
query("mixed_groups", "SELECT CASE WHEN c_custkey % 7 IN (4, 5) THEN NULL ELSE 'true' END AS b, count(*) AS n FROM customer WHERE c_custkey % 7 IN (3, 4, 5) GROUP BY 1")(lambda s, d: mixed_documents(s, d).sql("SELECT x AS b, COUNT(*) AS n FROM mixed WHERE x IS NULL OR x = TRUE AND k > 1 GROUP BY x").withColumn("b", F.when(F.col("b") == "1", "true")))

# ---- JSON functions

PROPS = "SELECT event_id, json_get(props, '$.k') AS k, json_type(props, '$.k') AS t, json_keys(props, '$') AS ks, json_type(props, '$') AS root, json_get(props, '$.none') AS gone FROM events"
query("json_get_type_keys", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' WHEN json_type(props, '$.k') = 'VARCHAR' THEN 'string' END AS t, '[' || array_to_string(list_transform(json_keys(props), lambda x: '\"' || x || '\"'), ',') || ']' AS ks, 'object' AS root, CAST(NULL AS VARCHAR) AS gone FROM events")(lambda s, d: engine(s, d, "events").sql(PROPS))
CHANGED = "SELECT event_id, json_set(props, '$.a.b', user_id) AS s, json_delete(props, '$.k') AS d, json_merge(props, '{\"z\":true}') AS m, json_contains('[1,2,{\"a\":1}]', '$', 2) AS c, json_array_length('[1,2,3]', '$') AS l, json_get_all('{\"a\":[{\"b\":1},{\"b\":\"x\"}]}', '$.a[*].b') AS ga, json_get('[5,6]', '$[-1]') AS last FROM events"
query("json_set_delete_merge", "SELECT event_id, '{\"k\":' || json_extract(props, '$.k')::VARCHAR || ',\"a\":{\"b\":' || user_id || '}}' AS s, '{}' AS d, '{\"k\":' || json_extract(props, '$.k')::VARCHAR || ',\"z\":true}' AS m, true AS c, CAST(3 AS BIGINT) AS l, '[1,\"x\"]' AS ga, '6' AS last FROM events")(lambda s, d: engine(s, d, "events").sql(CHANGED))

# ---- search

COSINE = "list_cosine_similarity(embedding::DOUBLE[], {q}::DOUBLE[])"
for _name, _metric, _score in (("vector_cosine_topk", "cosine", COSINE), ("vector_l2_topk", "l2", "1 / (1 + list_distance(embedding::DOUBLE[], {q}::DOUBLE[]))"), ("vector_ip_topk", "ip", "list_inner_product(embedding::DOUBLE[], {q}::DOUBLE[])")):

    def _vector(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        hits = search.vector_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", vector(1), metric, 20)
        return hits.select(F.col("id").alias("vec_id"), F.round(F.col("score").cast("double"), 4).alias("score"))

    query(_name, f"SELECT vec_id, round({_score.format(q=vector(1))}, 4) AS score FROM embeddings ORDER BY {_score.format(q=vector(1))} DESC, vec_id LIMIT 20")(_vector)


@query("similarity_sql", f"SELECT vec_id FROM embeddings WHERE label > 1 ORDER BY {COSINE.format(q=vector(2))} DESC, vec_id LIMIT 5")
def similarity_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter is applied to the candidates, which are the nearest 50."""
    e = engine(spark, sf_dir, "embeddings", embeddings="vec_id")
    return e.sql("SELECT vec_id FROM embeddings WHERE label > 1 AND SIMILARITY(embedding, ?) > -2 ORDER BY SIMILARITY(embedding, ?) DESC LIMIT 5", [tuple(vector(2)), tuple(vector(2))])


_WORDS = f"regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')"
_STOP = "['" + "','".join(STOP_WORDS) + "']"
BM25_SQL = f"""
WITH t AS (SELECT doc_id, list_filter({_WORDS}, lambda w: length(w) <= 64 AND NOT list_contains({_STOP}, w)) AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w)) / count(*) FILTER (len(w) > 0) AS mean FROM t),
q AS (SELECT unnest(['worthless', 'thereation', 'license']) AS term),
f AS (SELECT q.term, count(*) AS df FROM q JOIN t ON list_contains(t.w, q.term) GROUP BY 1),
p AS (SELECT t.doc_id, len(t.w) AS len, len(list_filter(t.w, lambda w: w = q.term))::DOUBLE AS tf, ln(1 + (s.n - coalesce(f.df, 0) + 0.5) / (coalesce(f.df, 0) + 0.5)) AS idf, s.mean FROM t, q LEFT JOIN f USING (term), s),
r AS (SELECT doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM p GROUP BY 1 HAVING sum(tf) > 0)
SELECT doc_id, round(score, 4) AS score FROM r ORDER BY round(score, 6) DESC, doc_id LIMIT 25
"""


def _bm25(spark: SparkSession, sf_dir: str, stemmed: bool) -> DataFrame:
    index = search.analyzed(table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}, False)
    hits = search.bm25(index, {"text": 1.0}, TERMS, stemmed).select(F.col("id").alias("doc_id"), F.col("score").cast("double").alias("s"))
    return hits.orderBy(F.desc(F.round("s", 6)), "doc_id").limit(25).select("doc_id", F.round("s", 4).alias("score"))


query("bm25_simple_topk", BM25_SQL)(lambda s, d: _bm25(s, d, False))


def _arms(spark: SparkSession, sf_dir: str) -> list[search.Arm]:
    e = table(spark, sf_dir, "embeddings")
    return [search.Arm(search.vector_search(e, "vec_id", "embedding", vector(n)).withColumn("score", F.round("score", 4).cast("float")), w, 60) for n, w in ((1, 1.0), (2, 0.5))]


_ARM = "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {q}::DOUBLE[])::FLOAT, 4)::FLOAT AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 60"
_A, _B = _ARM.format(q=vector(1)), _ARM.format(q=vector(2))
query("fuse_rrf", f"WITH a AS ({_A}), b AS ({_B}), u AS (SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS p FROM a UNION ALL SELECT vec_id, 0.5 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS p FROM b) SELECT vec_id, round(sum(p), 6) AS score FROM u GROUP BY 1")(lambda s, d: search.fuse(_arms(s, d), "rrf").select(F.col("id").alias("vec_id"), F.round(F.col("score").cast("double"), 6).alias("score")))
query("fuse_weighted", f"WITH a AS ({_A}), b AS ({_B}), u AS (SELECT vec_id, (score::DOUBLE - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS p FROM a UNION ALL SELECT vec_id, 0.5 * (score::DOUBLE - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS p FROM b) SELECT vec_id, round(sum(p), 4) AS score FROM u GROUP BY 1")(lambda s, d: search.fuse(_arms(s, d), "weighted").select(F.col("id").alias("vec_id"), F.round(F.col("score").cast("double"), 4).alias("score")))


# ---- versions


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operation log: a commit each, documents by user, an error deletes."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("op"), "ts", "event_type", "value")


_SNAP = "SELECT user_id AS id, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE {w}) WHERE r = 1 AND event_type <> 'error'"
query("snapshot_as_of_commit", _SNAP.format(w="event_id <= 6000"))(lambda s, d: history.snapshot(event_log(s, d), 6000).select("id", "seq", "value"))
query("snapshot_as_of_time", _SNAP.format(w=f"ts <= TIMESTAMP '{NOW}'"))(lambda s, d: history.snapshot_at(event_log(s, d), F.lit(NOW).cast("timestamp")).select("id", "seq", "value"))
query("commit_diff", f"WITH a AS ({_SNAP.format(w='event_id <= 4000')}), b AS ({_SNAP.format(w='event_id <= 8000')}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.value IS DISTINCT FROM b.value")(lambda s, d: history.diff(history.snapshot(event_log(s, d), 4000), history.snapshot(event_log(s, d), 8000), compare=["value"]))
query("doc_history", "SELECT user_id AS id, event_id AS seq, row_number() OVER w AS version, lag(event_id) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")(lambda s, d: history.document_history(event_log(s, d)).select("id", "seq", "version", "previous"))
query("revert_operations", f"WITH a AS ({_SNAP.format(w='event_id <= 8000')}), b AS ({_SNAP.format(w='event_id <= 4000')}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'delete' ELSE 'write' END AS op, b.value FROM a FULL JOIN b ON a.id = b.id WHERE a.value IS DISTINCT FROM b.value")(lambda s, d: history.revert_operations(history.snapshot(event_log(s, d), 8000), history.snapshot(event_log(s, d), 4000), body="value"))
query("ttl_visible", f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR")(lambda s, d: history.visible(table(s, d, "events"), "ts", F.lit(NOW).cast("timestamp"), 3600).select("event_id"))
query("feed_filtered_ops", "SELECT event_id AS seq, user_id AS id, CASE WHEN event_type = 'error' OR NOT value > 50 THEN 'delete' ELSE 'write' END AS op, CASE WHEN event_type <> 'error' AND value > 50 THEN value END AS value FROM events")(lambda s, d: feed.filtered(event_log(s, d), F.col("value") > 50, body="value").select("seq", "id", "op", "value"))

_SIDES = "SELECT c_custkey AS id, c_name AS base_name, c_acctbal AS base_bal, c_mktsegment AS base_seg, CASE WHEN c_custkey % 3 = 0 THEN 'L' ELSE c_name END AS local_name, c_acctbal AS local_bal, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS local_seg, CASE WHEN c_custkey % 2 = 0 THEN 'R' ELSE c_name END AS remote_name, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS remote_bal, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS remote_seg FROM customer"


@query(
    "three_way_diff",
    f"WITH s AS ({_SIDES}), u AS (" + " UNION ALL ".join(f"SELECT id, '/{f}' AS path, CASE WHEN base_{f} = local_{f} AND base_{f} = remote_{f} THEN NULL WHEN base_{f} = local_{f} THEN 'remote' WHEN base_{f} = remote_{f} THEN 'local' WHEN local_{f} = remote_{f} THEN 'same' ELSE 'both' END AS side FROM s" for f in ("name", "bal", "seg")) + ") SELECT * FROM u WHERE side IS NOT NULL",
)
def three_way_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    sides = c.select(
        k.alias("id"), F.col("c_name").alias("base_name"), F.col("c_acctbal").alias("base_bal"), F.col("c_mktsegment").alias("base_seg"),
        F.when(k % 3 == 0, "L").otherwise(F.col("c_name")).alias("local_name"), F.col("c_acctbal").alias("local_bal"), F.when(k % 5 == 0, "X").otherwise(F.col("c_mktsegment")).alias("local_seg"),
        F.when(k % 2 == 0, "R").otherwise(F.col("c_name")).alias("remote_name"), F.when(k % 4 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("remote_bal"), F.when(k % 10 == 0, "X").otherwise(F.col("c_mktsegment")).alias("remote_seg"),
    )
    return merge.three_way_columns(sides, "id", ["name", "bal", "seg"])


# ---- writes, against a store in the shared folder


def customer_store(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.to_json(F.struct(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))).alias("body"))
    e.sql("CREATE TABLE customers (key BIGINT NOT NULL UNIQUE, bal DOUBLE, seg VARCHAR)")
    e.put("customers", docs)
    return e


READ = "SELECT key, bal, seg, note FROM customers"


@query("update_set_remove", "SELECT c_custkey AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS bal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_mktsegment = 'BUILDING' THEN 'moved' END AS note FROM customer WHERE c_custkey <> 7")
def update_set_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customer_store(spark, sf_dir)
    e.sql("UPDATE customers SET bal = bal + 100, note = 'moved' REMOVE seg WHERE seg = 'BUILDING'")
    e.sql("DELETE FROM customers WHERE key = 7")
    return e.sql(READ)


@query("upsert_on_conflict", "SELECT c_custkey AS key, CASE WHEN c_custkey IN (1, 3) THEN c_acctbal + 1 ELSE c_acctbal END AS bal, c_mktsegment AS seg, CASE WHEN c_custkey IN (1, 3) THEN 'hit' END AS note FROM customer UNION ALL SELECT 900001, 5.5, 'NEW', NULL")
def upsert_on_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customer_store(spark, sf_dir)
    e.sql("INSERT INTO customers (key, bal, seg) VALUES (1, 0.0, 'a'), (3, 0.0, 'b'), (900001, 5.5, 'NEW') ON CONFLICT (key) DO UPDATE SET bal = bal + 1, note = 'hit'")
    e.sql("INSERT INTO customers (key, bal, seg) VALUES (2, 0.0, 'a') ON CONFLICT (key) DO NOTHING")
    return e.sql(READ)


@query("claim_order_limit", "SELECT c_custkey AS key, 'busy' AS note FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def claim_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customer_store(spark, sf_dir)
    return e.sql("UPDATE customers SET note = 'busy' WHERE seg <> 'BUILDING' ORDER BY bal DESC, key LIMIT 5 RETURNING key, note").returned.select(F.col("key").cast("bigint").alias("key"), "note")


@query("time_travel_at_commit", "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS s FROM customer")
def time_travel_at_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = customer_store(spark, sf_dir)
    e.collection("customers").store.tag("loaded")
    e.sql("DELETE FROM customers WHERE key > 100")
    e.sql("UPDATE customers SET key = key + 1000 WHERE key <= 5")
    return e.sql("SELECT COUNT(*) AS n, SUM(key) AS s FROM customers AT COMMIT 'head~2'")


@query("derived_uuid", f"WITH h AS (SELECT c_custkey, sha256(unhex('{SPACE.replace('-', '')}') || encode(c_name)) AS h FROM customer) SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', 1 + ('0x' || substr(h, 17, 1))::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h")
def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", derived_uuid(SPACE, F.col("c_name")).alias("id"))


from docloom import store_queries  # noqa: E402, F401  more queries, which use what is above
