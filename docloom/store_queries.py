"""More queries by name: stores, versions, writes, merges, feeds, indexes and search, with their DuckDB equivalents."""

from __future__ import annotations

import functools
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import json_text
from docloom.functions.identity import content_hash
from docloom.functions.text_analysis import STOP_WORDS
from docloom.operators import constraints, history, merge, search
from docloom.operators.access import AccessError
from docloom.plans.syntax import ColumnDef, SqlError
from docloom.queries import TERMS, customer_store, engine, event_log, mixed_documents, order_documents, query, table, vector
from docloom.session import ConstraintError, ConflictError, Engine
from docloom.sources.store import shared_folder
from docloom.streaming import feed

KEY = "c_custkey AS key"
BUILDING = "c_mktsegment = 'BUILDING'"


def loaded(spark: SparkSession, sf_dir: str):
    """The customers in a store: (engine, store)."""
    e = customer_store(spark, sf_dir)
    return e, e.collection("customers").store


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"


# ---- expressions and results

query("bare_boolean", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 = 3")(lambda s, d: mixed_documents(s, d).sql("SELECT _id AS id FROM mixed WHERE x"))
query("reserved_columns", "SELECT c_custkey AS id, '{\"k\":' || c_custkey || CASE c_custkey % 7 WHEN 3 THEN ',\"x\":true}' ELSE ',\"x\":null}' END AS doc FROM customer WHERE c_custkey % 7 IN (3, 4)")(lambda s, d: mixed_documents(s, d).sql("SELECT _id AS id, _doc AS doc FROM mixed WHERE x = TRUE AND k > 1 AND NOT (x = 1.5) OR x IS NULL AND EXISTS(x)").where("doc LIKE '%true%' OR doc LIKE '%null%'"))
query("inferred_types", "SELECT c_custkey AS k, c_custkey % 7 = 3 AS yes FROM customer WHERE c_custkey % 7 IN (3)")(lambda s, d: mixed_documents(s, d).sql("SELECT k, x AS yes FROM mixed WHERE x", infer_types=True).withColumn("yes", F.col("yes").cast("string").isin("1", "true")))
query("stand_alone_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")(lambda s, d: order_documents(s, d, False).collections["orders"].frame.where(Engine(s).predicate("items.l_quantity > 49 AND o_orderstatus = 'F'", "_doc")).select(F.col("_id").alias("o_orderkey")))
query("point_get", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 77)")(lambda s, d: engine(s, d, "customer", customer="c_custkey").get("customer", 5, 77).select("c_custkey", "c_name"))
query("from_base64", "SELECT c_custkey, upper(hex(from_base64(base64(encode(c_name))))) AS h FROM customer")(lambda s, d: engine_of(s, table(s, d, "customer").select("c_custkey", F.base64(F.col("c_name").cast("binary")).alias("b"))).sql("SELECT c_custkey, FROM_BASE64(b) AS h FROM t").withColumn("h", F.hex("h")))
query("content_hash", "SELECT c_custkey, sha256(c_name) AS h FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", content_hash(F.col("c_name")).alias("h")))
query("canonical_json", "SELECT c_custkey AS id, '{\"a\":[1,{\"x\":' || c_custkey || ',\"y\":2}],\"b\":\"' || c_name || '\"}' AS c FROM customer")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id"), json_text.canonical(F.concat(F.lit('{ "b" : "'), "c_name", F.lit('", "a":[1 , {"y":2,"x": '), "c_custkey", F.lit("}]}"))).alias("c"))
)
query("deep_equality", "SELECT c_custkey AS id, c_custkey % 3 = 0 AS held FROM customer")(
    lambda s, d: engine_of(s, table(s, d, "customer").select("c_custkey", F.concat(F.lit('[{"b":[1,2],"a":'), F.col("c_custkey") % 3, F.lit("},7]")).alias("doc"))).sql("SELECT c_custkey AS id, JSON_CONTAINS(doc, '$', '{\"a\":0,\"b\":[1,2]}') AS held FROM t")
)
_ITEMS = "SELECT l_orderkey, count(*) AS n, '[' || string_agg(CAST(l_quantity AS VARCHAR), ',' ORDER BY l_linenumber, l_quantity, l_returnflag) || ']' AS q, bool_or(l_linenumber = 5) AS five FROM lineitem GROUP BY 1"
query("json_on_documents", f"SELECT o_orderkey AS id, i.n, i.q, '\"' || o_orderstatus || '\"' AS status, '{{\"o_custkey\":' || o_custkey || ',\"z\":1}}' AS m FROM orders JOIN ({_ITEMS}) i ON l_orderkey = o_orderkey")(
    lambda s, d: order_documents(s, d, False).sql("SELECT _id AS id, JSON_ARRAY_LENGTH(_doc, '$.items') AS n, JSON_GET_ALL(_doc, '$.items[*].l_quantity') AS q, JSON_GET(_doc, '$.o_orderstatus') AS status, JSON_MERGE(JSON_DELETE(JSON_DELETE(JSON_DELETE(_doc, '$.items'), '$.o_orderkey'), '$.o_orderstatus'), '{\"z\":1}') AS m FROM orders")
)


def engine_of(spark: SparkSession, frame: DataFrame) -> Engine:
    e = Engine(spark)
    e.register("t", frame)
    return e


BAD = [
    ("aggregate in where", "SELECT n_name FROM nation WHERE COUNT(*) > 1"), ("unknown column", "SELECT nope FROM nation"), ("unknown table", "SELECT a FROM nowhere"),
    ("column not grouped", "SELECT n_name, COUNT(*) FROM nation GROUP BY n_regionkey"), ("star in group", "SELECT * FROM nation GROUP BY n_regionkey"), ("bad syntax", "SELECT FROM WHERE"), ("two arguments", "SELECT SUM(n_nationkey, 1) FROM nation"),
    ("no from", "SELECT * WHERE 1 = 1"), ("versions of a table", "SELECT n_name FROM nation AT VERSION 'x'"), ("write to a table", "DELETE FROM nation"),
]


@query("validation_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n, _ in BAD) + ") AS v(name, refused)")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    out = []
    for name, text in BAD:
        try:
            e.sql(text)
            out.append((name, False))
        except SqlError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, refused boolean")


# ---- search

_STOP = "['" + "','".join(STOP_WORDS) + "']"
_TOKENS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: length(w) <= 64 AND NOT list_contains(" + _STOP + ", w))"
# The words of the documents that share a stem with a word of the query (found by Porter's rules).
STEMS = {"worthless": "worthless", "thereation": "thereat", "license": "licens", "licensed": "licens", "licenses": "licens", "licensing": "licens"}
_STEMMED = "list_transform(" + _TOKENS.format("text") + ", lambda w: CASE w " + " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in STEMS.items()) + " ELSE w END)"


def bm25_sql(source: str, key: str, fields: dict[str, float], terms: list[str], keep: str = "true") -> str:
    """BM25 over fields (SQL that gives token lists f0, f1, ... in `source`)."""
    n = range(len(fields))
    return f"""
WITH t AS ({source}),
s AS (SELECT count(*) FILTER ({" + ".join(f"len(f{i})" for i in n)} > 0) AS n, {", ".join(f"sum(len(f{i})) AS l{i}" for i in n)} FROM t),
q AS (SELECT unnest({terms}) AS term),
f AS (SELECT q.term, count(*) AS df FROM q JOIN t ON {" OR ".join(f"list_contains(t.f{i}, q.term)" for i in n)} GROUP BY 1),
p AS (SELECT t.{key}, ln(1 + (s.n - coalesce(f.df, 0) + 0.5) / (coalesce(f.df, 0) + 0.5)) AS idf, s.n, {", ".join(f"len(list_filter(t.f{i}, lambda w: w = q.term))::DOUBLE AS tf{i}, len(t.f{i}) AS len{i}, s.l{i} / s.n AS mean{i}" for i in n)} FROM t, q LEFT JOIN f USING (term), s WHERE {keep}),
r AS (SELECT {key}, sum({" + ".join(f"{w} * idf * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len{i} / mean{i}))" for i, w in enumerate(fields.values()))}) AS score FROM p GROUP BY 1 HAVING sum({" + ".join(f"tf{i}" for i in n)}) > 0)
"""


def top(hits: DataFrame, key: str, k: int = 25) -> DataFrame:
    own = hits.select(F.col("id").alias(key), F.col("score").cast("double").alias("s"))
    return own.orderBy(F.desc(F.round("s", 5)), key).limit(k).select(key, F.round("s", 3).alias("score"))


@query("bm25_porter_topk", bm25_sql(f"SELECT doc_id, {_STEMMED} AS f0 FROM documents", "doc_id", {"text": 1.0}, ["worthless", "thereat", "licens"]) + "SELECT doc_id, round(score, 3) AS score FROM r ORDER BY round(score, 5) DESC, doc_id LIMIT 25")
def bm25_porter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(search.bm25(search.analyzed(table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0}), {"text": 1.0}, TERMS), "doc_id")


_PART = f"SELECT p_partkey, {_TOKENS.format('p_name')} AS f0, {_TOKENS.format('p_type')} AS f1 FROM part"
_PHRASE = "(' ' || array_to_string(t.f0, ' ') || ' ') LIKE '% hot gear %'"


@query("match_fields_phrase", bm25_sql(_PART, "p_partkey", {"p_name": 3.0, "p_type": 1.0}, ["small", "hot", "gear"], _PHRASE) + "SELECT p_partkey, round(score, 3) AS score FROM r")
def match_fields_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "part", part="p_partkey")
    e.sql("CREATE INDEX ft ON part (p_name WEIGHT 3, p_type) USING FULLTEXT")
    found = e.sql("SELECT p_partkey, MATCH(ft, 'small \"hot gear\"') AS score FROM part WHERE MATCH(ft, 'small \"hot gear\"')")
    return found.select("p_partkey", F.round(F.col("score").cast("double"), 3).alias("score"))


query("match_any_term", "SELECT p_partkey FROM part WHERE p_name LIKE '%gizmo%' OR p_name LIKE '%bolt%'")(lambda s, d: engine(s, d, "part", part="p_partkey").sql("SELECT p_partkey FROM part WHERE MATCH(p_name, 'gizmo bolt')"))


@query("stored_fulltext_topk", bm25_sql("SELECT p_partkey, " + _TOKENS.format("CASE WHEN p_partkey % 9 = 0 THEN 'small hot bolt' ELSE p_name END") + " AS f0 FROM part WHERE p_partkey % 9 <> 1", "p_partkey", {"name": 1.0}, ["small", "bolt"]) + "SELECT p_partkey, round(score, 3) AS score FROM r ORDER BY round(score, 5) DESC, p_partkey LIMIT 25")
def stored_fulltext_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the stored index, of which a ninth is replaced and a ninth deleted since it was built."""
    e = Engine(spark, fresh_folder(spark))
    doc = lambda name: F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("key"), name.alias("name"))).alias("body")
    part = table(spark, sf_dir, "part")
    e.put("parts", part.select(doc(F.col("p_name"))))
    e.sql("CREATE INDEX ft ON parts (name) USING FULLTEXT")
    e.put("parts", part.where("p_partkey % 9 = 0").select(doc(F.lit("small hot bolt"))))
    e.sql("CREATE TABLE parts (key BIGINT)")
    gone = part.where("p_partkey % 9 = 1").select(F.col("p_partkey").alias("key"))
    head, store = e.collection("parts").store.head(), e.collection("parts").store
    ids = store.snapshot().select("id", F.get_json_object("body", "$.key").cast("long").alias("key")).join(gone, "key", "left_semi")
    store.commit(ids.select("id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("body")), "delete", expected=head)
    hits = e.sql("SELECT key AS id, MATCH(ft, 'small bolt') AS score FROM parts WHERE MATCH(ft, 'small bolt')")
    return top(hits.withColumn("id", F.col("id").cast("long")), "p_partkey")


@query("search_api", "SELECT vec_id AS id, label FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], " + str(vector(3)) + "::DOUBLE[]) DESC, vec_id LIMIT 10")
def search_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "embeddings", embeddings="vec_id")
    return e.search("embeddings", vector=("embedding", vector(3)), limit=10).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").select("id", "label")


@query("vector_cells_recall", "SELECT count(*) AS queries, true AS recalled, true AS exact_with_all_cells FROM embeddings WHERE vec_id % 50 = 0")
def vector_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucketed vector index, asked for every fiftieth vector: at least 0.9 of the true nearest ten with three quarters of its cells, all with all."""
    df = table(spark, sf_dir, "embeddings")
    index = search.build_cells(df, "vec_id", "embedding", cells=16)
    at = fresh_folder(spark)
    index.rows.write.partitionBy("cell").parquet(at)
    index = search.Cells(spark.read.parquet(at), index.centres)
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    arms = {"want": search.search_many(df, "vec_id", "embedding", asked), "some": search.cell_search_many(index, asked, probes=12), "whole": search.cell_search_many(index, asked, probes=16)}
    found = functools.reduce(DataFrame.unionAll, [hits.select("query", "id", *[F.lit(int(a == name)).alias(a) for a in arms]) for name, hits in arms.items()])
    each = found.groupBy("query", "id").agg(*[F.max(a).alias(a) for a in arms]).where("want = 1")
    n = asked.count()
    return each.agg(F.lit(n).cast("long").alias("queries"), (F.coalesce(F.sum("some"), F.lit(0)) >= 9 * n).alias("recalled"), (F.coalesce(F.sum("whole"), F.lit(0)) == 10 * n).alias("exact_with_all_cells"))


# ---- indexes of a store


@query("index_lookup_store", "SELECT c_custkey AS key FROM customer WHERE CASE WHEN c_custkey % 10 = 3 THEN 100.5 ELSE c_acctbal END BETWEEN 100 AND 900 AND c_custkey <> 13")
def index_lookup_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a BTREE index that is behind two commits."""
    e, _ = loaded(spark, sf_dir)
    e.sql("CREATE INDEX by_bal ON customers (bal) USING BTREE")
    changed = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.to_json(F.struct(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), F.col("c_custkey").alias("key"), F.lit(100.5).alias("bal"), F.col("c_mktsegment").alias("seg"))).alias("body"))
    e.put("customers", changed)
    e.sql("DELETE FROM customers WHERE key = 13")
    return e.sql("SELECT key FROM customers WHERE bal BETWEEN 100 AND 900")


@query("index_in_list", "SELECT c_custkey AS key, c_mktsegment AS seg FROM customer WHERE c_custkey IN (3, 5, 700, 1400)")
def index_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = loaded(spark, sf_dir)
    e.sql("CREATE INDEX by_key ON customers (key) USING HASH")
    return e.sql("SELECT key, seg FROM customers WHERE key IN (3, 5, 700, 1400)")


@query("explain_access", "SELECT * FROM (VALUES ('index:eq', 1::BIGINT), ('index:range', (SELECT count(*) FROM customer WHERE c_custkey < 10)), ('scan', (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING')), ('singlerow', 1::BIGINT)) AS v(plan, rows)")
def explain_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = loaded(spark, sf_dir)
    e.sql("CREATE INDEX by_key ON customers (key) USING BTREE")
    out = [e.sql("EXPLAIN " + q).select("plan", "rows") for q in ("SELECT key FROM customers WHERE key = 5", "SELECT key FROM customers WHERE key < 10", "SELECT key FROM customers WHERE seg = 'BUILDING'", "SELECT 1 AS one")]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


# ---- versions

_ALL = "count(*) AS n, sum(c_custkey)::BIGINT AS s FROM customer"


@query("at_version_and_time", f"SELECT 'version' AS read, {_ALL} UNION ALL SELECT 'time', {_ALL} UNION ALL SELECT 'before', 0, NULL UNION ALL SELECT 'head', {_ALL} WHERE c_custkey <= 100")
def at_version_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, store = loaded(spark, sf_dir)
    store.tag("v1")
    first = store.commits[store.head()].ts
    e.sql("DELETE FROM customers WHERE key > 100")
    read = lambda name, at: e.sql(f"SELECT COUNT(*) AS n, SUM(key) AS s FROM customers {at}").select(F.lit(name).alias("read"), "n", F.col("s").cast("bigint").alias("s"))
    out = [read("version", "AT VERSION 'v1'"), read("time", f"AT TIME '{first.isoformat()}'"), read("before", f"AT TIME '{(first - timedelta(hours=1)).isoformat()}'"), read("head", "")]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query("checkout_pinned", f"SELECT {_ALL}")
def checkout_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = loaded(spark, sf_dir)
    e.sql("DELETE FROM customers WHERE key > 100")
    e.checkout("customers", "head^")
    return e.sql("SELECT COUNT(*) AS n, SUM(key) AS s FROM customers").withColumn("s", F.col("s").cast("bigint"))


@query("commit_log", "SELECT * FROM (VALUES (3, 'write', 1, true), (2, 'write', 1, true), (1, 'write', 0, false)) AS v(seq, message, parents, descends_from_first)")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, store = loaded(spark, sf_dir)
    e.sql("DELETE FROM customers WHERE key > 100")
    e.sql("UPDATE customers SET note = 'x' WHERE key < 3")
    first = store.resolve("head~2")
    rows = [(r["commit"], store.is_ancestor(first, r["commit"]) and r["commit"] != first) for r in store.log().collect()]
    return store.log().join(spark.createDataFrame(rows, "commit string, descends_from_first boolean"), "commit").select(F.col("seq").cast("int").alias("seq"), "message", F.size("parents").alias("parents"), "descends_from_first")


@query("branches_and_tags", "SELECT * FROM (VALUES ('branch:dev', (SELECT count(*) FROM customer WHERE c_custkey <= 100)), ('tag:v1', (SELECT count(*) FROM customer)), ('dev~1', (SELECT count(*) FROM customer)), ('head', (SELECT count(*) FROM customer) - 1)) AS v(revision, n)")
def branches_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, store = loaded(spark, sf_dir)
    store.tag("v1")
    store.branch("dev")
    gone = store.snapshot().where(F.get_json_object("body", "$.key").cast("long") > 100)
    store.commit(gone.select("id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("body")), branch="dev")
    e.sql("DELETE FROM customers WHERE key = 1")
    return spark.createDataFrame([(r, store.snapshot(r).count()) for r in ("branch:dev", "tag:v1", "dev~1", "head")], "revision string, n long")


@query("page_at_revision", "SELECT c_custkey AS key FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 10")
def page_at_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a listing, whose ids follow the keys, at the revision of the first."""
    e, store = loaded(spark, sf_dir)
    pinned = store.head()
    e.sql("DELETE FROM customers WHERE key > 15")
    e.checkout("customers", pinned)
    return e.sql("SELECT key FROM customers ORDER BY key LIMIT 30 OFFSET 10")


def halves(spark: SparkSession, sf_dir: str):
    """A branch dev that moves every third customer to segment X, and main that gives every second one 100 more."""
    e, store = loaded(spark, sf_dir)
    store.branch("dev")
    own = store.snapshot().withColumn("k", F.get_json_object("body", "$.key").cast("long")).where("k % 3 = 0")
    store.commit(own.select("id", F.lit("write").alias("op"), F.to_json(F.struct(F.get_json_object("body", "$.id").alias("id"), F.col("k").alias("key"), F.get_json_object("body", "$.bal").cast("double").alias("bal"), F.lit("X").alias("seg"))).alias("body")), branch="dev")
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    more = F.to_json(F.struct(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), F.col("c_custkey").alias("key"), (F.col("c_acctbal") + 100).alias("bal"), F.col("c_mktsegment").alias("seg")))
    e.put("customers", c.select(more.alias("body")))
    return e, store


@query("merge_branches", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS seg FROM customer")
def merge_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = halves(spark, sf_dir)
    e.merge("customers", "dev", policy="strict")
    return e.sql("SELECT key, bal, seg FROM customers")


@query("common_ancestor", "SELECT 1 AS ancestor_seq, 1 AS only_main, 1 AS only_dev")
def common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, store = halves(spark, sf_dir)
    main, dev = store.resolve("head"), store.resolve("dev")
    root = store.common_ancestor(main, dev)
    return spark.createDataFrame([(store.commits[root].seq, len(store.commits_since(root, main)), len(store.commits_since(root, dev)))], "ancestor_seq int, only_main int, only_dev int")


@query("compacted_attachments", "SELECT c_custkey AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS n, CASE WHEN c_mktsegment = 'BUILDING' THEN '6869' END AS h FROM customer WHERE c_custkey <> 7")
def compacted_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, store = loaded(spark, sf_dir)
    e.sql("UPDATE customers SET ATTACHMENT 'a.txt' = X'6869' MIME 'text/plain' WHERE seg = 'BUILDING'")
    e.sql("DELETE FROM customers WHERE key = 7")
    store.compact("head")
    return e.sql("SELECT key, ATTACHMENT_COUNT() AS n, ATTACHMENT('a.txt') AS h FROM customers").select("key", F.col("n").cast("int").alias("n"), F.hex("h").alias("h"))


@query("attachment_functions", f"SELECT {KEY}, 2 AS n, 3::BIGINT AS size, 'text/plain' AS mime, '010203' AS content FROM customer WHERE {BUILDING}")
def attachment_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = loaded(spark, sf_dir)
    e.sql("UPDATE customers SET ATTACHMENT 'a' = X'00', ATTACHMENT 'b' = X'010203' MIME 'text/plain', ATTACHMENT 'c' = X'04' WHERE seg = 'BUILDING'")
    e.sql("UPDATE customers DROP ATTACHMENT 'c', RENAME ATTACHMENT 'b' TO 'd' WHERE seg = 'BUILDING'")
    read = e.sql("SELECT key, ATTACHMENT_COUNT() AS n, ATTACHMENT_SIZE('d') AS size, ATTACHMENT_MIME('d') AS mime, ATTACHMENT('d') AS content FROM customers WHERE seg = 'BUILDING'")
    return read.withColumn("n", F.col("n").cast("int")).withColumn("content", F.hex("content"))


@query("retained_history", f"SELECT 'head' AS revision, {_ALL} UNION ALL SELECT 'mark', {_ALL}")
def retained_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten versions of the customers thinned out to the tagged and the last ones, which read as before."""
    e, store = loaded(spark, sf_dir)
    store.tag("mark")
    for i in range(3):
        e.sql(f"UPDATE customers SET note = 'n{i}' WHERE key = {i + 1}")
    dropped = store.retain([(timedelta(0), "tagged")], datetime.now(UTC) + timedelta(days=1))
    assert len(dropped) == 2
    out = [store.snapshot(r).select(F.lit(n).alias("revision"), F.get_json_object("body", "$.key").cast("long").alias("k")).groupBy("revision").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("s")) for n, r in (("head", "head"), ("mark", "tag:mark"))]
    return out[0].unionAll(out[1])


# ---- writes


@query("transaction_two_collections", f"SELECT 'customers' AS name, count(*) AS n FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'log', 2")
def transaction_two_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = loaded(spark, sf_dir)
    e.sql("BEGIN")
    e.sql("DELETE FROM customers WHERE key = 7")
    e.sql("INSERT INTO log (what) VALUES ('delete'), ('seven')")
    e.sql("COMMIT")
    e.sql("BEGIN")
    e.sql("DELETE FROM customers WHERE key > 0")
    e.sql("ROLLBACK")
    again = Engine(spark, e.path)
    return again.sql("SELECT COUNT(*) AS n FROM customers").select(F.lit("customers").alias("name"), "n").unionAll(again.sql("SELECT COUNT(*) AS n FROM log").select(F.lit("log"), "n"))


@query("alter_table", f"SELECT {KEY}, CASE WHEN {BUILDING} THEN 5::BIGINT END AS level FROM customer")
def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = loaded(spark, sf_dir)
    e.sql("ALTER TABLE customers ADD COLUMN level BIGINT")
    e.sql("UPDATE customers SET level = 5 WHERE seg = 'BUILDING'")
    return Engine(spark, e.path).sql("SELECT key, level FROM customers")


STEPS = [("add_field", "b", ColumnDef("b", "string", True)), ("rename_field", "a", "z"), ("change_type", "z", "bigint"), ("widen_enum", "b", ("x", "y")), ("set_required", "z", True)]


@query("schema_migration", "SELECT * FROM (VALUES ('add_field', 'b', true), ('rename_field', 'a', true), ('change_type', 'z', true), ('widen_enum', 'b', false), ('set_required', 'z', true), ('diff:add_field', 'z', true), ('diff:drop_field', 'a', true), ('diff:add_field', 'b', true)) AS v(step, field, breaking)")
def schema_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = constraints.Schema((ColumnDef("a", "int"),))
    new = constraints.migrate(old, STEPS)
    rows = [(s[0], s[1], constraints.is_breaking(s)) for s in STEPS] + [(f"diff:{s[0]}", s[1], constraints.is_breaking(s)) for s in constraints.schema_diff(old, new)]
    return spark.createDataFrame(rows, "step string, field string, breaking boolean")


@query("refused_writes", "SELECT count(*) AS n, 4 AS refused FROM customer")
def refused_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taken unique key, a missing required field, a wrong type, and a change that makes keys equal: nothing is written."""
    e, _ = loaded(spark, sf_dir)
    refused = 0
    for text in ("INSERT INTO customers (key) VALUES (1)", "INSERT INTO customers (bal) VALUES (1.5)", "INSERT INTO customers (key) VALUES ('x')", "UPDATE customers SET key = 1"):
        try:
            e.sql(text)
        except ConstraintError:
            refused += 1
    return e.sql("SELECT COUNT(*) AS n FROM customers").withColumn("refused", F.lit(refused))


@query("returning_insert", "SELECT * FROM (VALUES (900001::BIGINT, 'new'), (900002, 'new')) AS v(key, seg)")
def returning_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = loaded(spark, sf_dir)
    return e.sql("INSERT INTO customers (key, seg) VALUES (900001, 'new'), (900002, 'new') RETURNING key, seg").returned.select(F.col("key").cast("bigint").alias("key"), "seg")


@query("precondition_write", f"SELECT {KEY}, CASE WHEN c_custkey % 10 = 0 THEN 'seen' ELSE c_mktsegment END AS seg, true AS stale_refused FROM customer")
def precondition_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replaced on the condition that they are still what was read; a second write on the same condition is refused."""
    e, store = loaded(spark, sf_dir)
    read = store.snapshot().withColumn("k", F.get_json_object("body", "$.key").cast("long")).where("k % 10 = 0")
    new = read.select("id", F.lit("write").alias("op"), F.to_json(F.struct(F.col("k").alias("key"), F.lit("seen").alias("seg"))).alias("body"))
    expected = read.select("id", content_hash(F.col("body")).alias("hash"))
    at = fresh_folder(spark)
    expected.write.parquet(at)
    expected = spark.read.parquet(at)
    e.write_if("customers", new, expected)
    try:
        e.write_if("customers", new, expected)
        refused = False
    except ConstraintError:
        refused = True
    return e.sql("SELECT key, seg FROM customers").withColumn("stale_refused", F.lit(refused))


@query("two_writers", f"SELECT count(*) AS n, 1 AS refused FROM customer WHERE c_custkey <> 7")
def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers from one head: the second goes on top if it writes other documents, and is refused if it writes the same."""
    _, store = loaded(spark, sf_dir)
    other = type(store)(spark, store.path)
    head = store.head()
    by_key = lambda k: store.snapshot(head).where(F.get_json_object("body", "$.key") == str(k))
    note = lambda k: by_key(k).select("id", F.lit("write").alias("op"), F.concat(F.lit('{"key":'), F.lit(k), F.lit(',"note":"x"}')).alias("body"))
    store.commit(by_key(7).select("id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("body")), expected=head)
    other.commit(note(8), expected=head)
    try:
        other.commit(note(7), expected=head)
        refused = 0
    except ConflictError:
        refused = 1
    return other.snapshot().agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


@query("lease_fencing", "SELECT * FROM (VALUES ('held by another', true), ('old fence', true), ('new fence', false)) AS v(case_, refused)")
def lease_fencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, store = loaded(spark, sf_dir)
    row = lambda i: spark.createDataFrame([(i, "write", "{}")], "id string, op string, body string")
    first = store.lease("load", "ann", 60)

    def refused(do) -> bool:
        try:
            do()
            return False
        except ConflictError:
            return True

    out = [("held by another", refused(lambda: store.lease("load", "bob", 60)))]
    second = store.lease("load", "bob", 600, now=first.until)
    out += [("old fence", refused(lambda: store.commit(row("a"), lease=first))), ("new fence", refused(lambda: store.commit(row("b"), lease=second)))]
    return spark.createDataFrame(out, "case_ string, refused boolean")


@query("ttl_sweep", "SELECT event_id AS id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'")
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, fresh_folder(spark))
    e.sql("CREATE TABLE events (n BIGINT, until TIMESTAMP)")
    until = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    e.put("events", table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("n"), until.alias("until"))).alias("body")))
    e.sweep("events", "until", datetime(2024, 1, 20, 12, tzinfo=UTC))
    return e.sql("SELECT n AS id FROM events")


# ---- merges

_TRIPLES = "SELECT c_custkey AS k FROM customer"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that local changed in a; remote changed b of the even ones and a of the odd ones."""
    k = F.col("c_custkey")
    doc = lambda a, b: F.concat(F.lit('{"a":'), a, F.lit(',"b":'), b, F.lit("}"))
    one, two, three, own = (F.lit(x) for x in ("1", "2", "3", "0"))
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), doc(one, k).alias("base"), doc(two, k).alias("local"), F.when(k % 2 == 0, doc(one, own)).otherwise(doc(three, k)).alias("remote"))


@query(
    "conflict_policies",
    f"WITH t AS ({_TRIPLES}) SELECT 'strict' AS policy, k::VARCHAR AS id, CASE WHEN k % 2 = 0 THEN 'doc' ELSE 'defer' END AS kind, CASE WHEN k % 2 = 0 THEN '{{\"a\":2,\"b\":0}}' END AS doc FROM t "
    "UNION ALL SELECT 'last_write', k::VARCHAR, 'take', '{\"a\":2,\"b\":' || k || '}' FROM t UNION ALL SELECT 'append_only', k::VARCHAR, 'defer', NULL FROM t "
    "UNION ALL SELECT 'custom', k::VARCHAR, 'doc', '{\"a\":' || CASE WHEN k % 2 = 0 THEN 2 ELSE 4 END || '}' FROM t",
)
def conflict_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two changes of a counter, the procedure adds both up."""
    t = triples(spark, sf_dir)
    add = lambda r: {"kind": "doc", "doc": {"a": r["local"]["a"] + r["remote"]["a"] - r["base"]["a"]}}
    out = [merge.resolve(t, p, add if p == "custom" else None).select(F.lit(p).alias("policy"), "id", "kind", "doc") for p in ("strict", "last_write", "append_only", "custom")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("three_way_json", f"WITH t AS ({_TRIPLES}) SELECT k::VARCHAR AS id, '/a' AS path, CASE WHEN k % 2 = 0 THEN 'local' ELSE 'both' END AS side, '1' AS base, '2' AS local, CASE WHEN k % 2 = 0 THEN '1' ELSE '3' END AS remote FROM t UNION ALL SELECT k::VARCHAR, '/b', 'remote', k::VARCHAR, k::VARCHAR, '0' FROM t WHERE k % 2 = 0 AND k <> 0")
def three_way_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).select("id", F.explode(merge.three_way_json("base", "local", "remote")).alias("x")).select("id", "x.*")


@query("procedure_host", f"SELECT k::VARCHAR AS id, 'doc' AS kind, '{{\"a\":' || (k % 25) || '}}' AS doc FROM ({_TRIPLES})")
def procedure_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named conflict procedure that looks up other documents: the nation of each customer, by key."""
    e = engine(spark, sf_dir, "nation", nation="n_nationkey")
    e.procedure("by_nation", lambda r, host: {"kind": "doc", "doc": {"a": host.get("nation", int(r["id"]) % 25)["n_nationkey"]}})
    return e.resolve(triples(spark, sf_dir), "by_nation", {"nation": "SELECT n_nationkey, n_name FROM nation"})


# ---- feeds

_OPS = "SELECT 1::BIGINT AS seq, c_custkey AS key, 'write' AS op FROM customer UNION ALL SELECT 2, c_custkey, 'delete' FROM customer WHERE c_custkey > 100 UNION ALL SELECT 3, c_custkey, 'write' FROM customer WHERE c_custkey < 3"


def fed(spark: SparkSession, sf_dir: str):
    """A store of three commits: all customers, a delete and an update."""
    e, store = loaded(spark, sf_dir)
    e.sql("DELETE FROM customers WHERE key > 100")
    e.sql("UPDATE customers SET note = 'x' WHERE key < 3")
    return e, store


def drained(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def keyed(ops: DataFrame) -> DataFrame:
    return ops.select("seq", F.col("id").alias("doc"), "op")


@query("change_feed_stream", "SELECT seq, count(*) AS n, op FROM (" + _OPS + ") GROUP BY seq, op")
def change_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, store = fed(spark, sf_dir)
    at = fresh_folder(spark)
    return drained(e.subscribe("customers"), f"{at}/out", f"{at}/checkpoint").groupBy("seq", "op").agg(F.count(F.lit(1)).alias("n"))


@query("feed_resume", "SELECT seq, count(*) AS n, op FROM (" + _OPS + ") GROUP BY seq, op")
def feed_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that stops behind the first commit goes on where it was: each operation comes once."""
    e, _ = loaded(spark, sf_dir)
    at = fresh_folder(spark)
    drained(e.subscribe("customers"), f"{at}/out", f"{at}/checkpoint")
    e.sql("DELETE FROM customers WHERE key > 100")
    e.sql("UPDATE customers SET note = 'x' WHERE key < 3")
    return drained(e.subscribe("customers"), f"{at}/out", f"{at}/checkpoint").groupBy("seq", "op").agg(F.count(F.lit(1)).alias("n"))


@query("feed_bootstrap", "SELECT 'delete' AS op, count(*) AS n FROM customer WHERE c_custkey > 100 UNION ALL SELECT 'write', count(*) FROM customer WHERE c_custkey < 3")
def feed_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, store = fed(spark, sf_dir)
    return feed.bootstrap(store.snapshot("head~2"), store.snapshot()).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("feed_fan_out", "SELECT 'all' AS reader, op, count(*) AS n FROM (" + _OPS + ") GROUP BY op UNION ALL SELECT 'building', CASE WHEN op = 'write' AND c_mktsegment = 'BUILDING' THEN 'write' ELSE 'delete' END, count(*) FROM (" + _OPS + ") o JOIN customer ON c_custkey = key GROUP BY 2")
def feed_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, store = fed(spark, sf_dir)
    at = fresh_folder(spark)
    sink = lambda name: lambda df, n: df.write.mode("overwrite").parquet(f"{at}/{name}/batch={n}")
    feed.fan_out(feed.change_feed(spark, store.path), {"all": (F.lit(True), sink("all")), "building": (e.predicate("seg = 'BUILDING'"), sink("building"))}, f"{at}/checkpoint").awaitTermination()
    out = [spark.read.parquet(f"{at}/{n}").select(F.lit(n).alias("reader"), "op") for n in ("all", "building")]
    return out[0].unionAll(out[1]).groupBy("reader", "op").agg(F.count(F.lit(1)).alias("n"))


@query("desync_commits", "SELECT namespace, commit, expected FROM (SELECT user_id % 50 AS namespace, event_id::VARCHAR AS commit, CASE WHEN event_id % 13 = 0 THEN 'lost' ELSE lag(event_id::VARCHAR) OVER w END AS parent, lag(event_id::VARCHAR) OVER w AS expected FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY event_id)) WHERE expected IS NOT NULL AND parent <> expected")
def desync_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.expr("lag(CAST(event_id AS STRING)) OVER (PARTITION BY user_id % 50 ORDER BY event_id)")
    commits = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("namespace"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("commit"), F.when(F.col("event_id") % 13 == 0, "lost").otherwise(before).alias("parent"))
    return feed.desync(commits)


@query("write_back", "SELECT c_custkey AS key, 'back' AS note FROM customer WHERE c_custkey < 50")
def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscriber writes what it made of the documents back as a commit on the head that it has read."""
    e, store = loaded(spark, sf_dir)
    head = store.head()
    own = e.sql("SELECT _id AS id, key FROM customers WHERE key < 50").select("id", F.lit("write").alias("op"), F.to_json(F.struct("key", F.lit("back").alias("note"))).alias("body"))
    store.commit(own, "write back", expected=head)
    return e.sql("SELECT key, note FROM customers WHERE note = 'back'")


query("history_of_one", "SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS version FROM events WHERE user_id = 17")(lambda s, d: history.document_history(event_log(s, d).where("id = 17")).select("seq", "version"))


# ---- access and consistency


@query("roles_and_grants", "SELECT * FROM (VALUES ('reader reads', true), ('reader writes', false), ('reader of one document', true), ('after revoke', false), ('wrong password', false)) AS v(case_, allowed)")
def roles_and_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, store = loaded(spark, sf_dir)
    for text in ("CREATE ROLE reader", "CREATE USER ann WITH PASSWORD 'pw' ROLES (reader)", "GRANT read ON COLLECTION main.customers TO reader"):
        e.sql(text)
    out = []

    def tried(name: str, do) -> None:
        try:
            do()
            out.append((name, True))
        except AccessError:
            out.append((name, False))

    ann = Engine(spark, e.path, user="ann", password="pw")
    tried("reader reads", lambda: ann.sql("SELECT COUNT(*) AS n FROM customers"))
    tried("reader writes", lambda: ann.sql("DELETE FROM customers WHERE key = 1"))
    e.sql("REVOKE read ON COLLECTION main.customers FROM reader")
    tried("after revoke", lambda: ann.sql("SELECT COUNT(*) AS n FROM customers"))
    one = store.snapshot().select(F.min("id")).first()[0]
    e.sql(f'GRANT read ON DOCUMENT "main.customers.{one}" TO reader')
    out.append(("reader of one document", ann.sql("SELECT key FROM customers").count() == 1))
    tried("wrong password", lambda: Engine(spark, e.path, user="ann", password="no"))
    return spark.createDataFrame(out, "case_ string, allowed boolean")


@query("read_consistency", "SELECT * FROM (VALUES ('snapshot', (SELECT count(*) FROM customer)), ('read_committed', (SELECT count(*) FROM customer) - 1), ('read_your_writes', (SELECT count(*) FROM customer))) AS v(consistency, n)")
def read_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers of each kind see of a delete that another engine commits between two of their reads."""
    e, _ = loaded(spark, sf_dir)
    readers = {c: Engine(spark, e.path, consistency=c) for c in ("snapshot", "read_committed", "read_your_writes")}
    count = lambda r: r.sql("SELECT COUNT(*) AS n FROM customers").first()["n"]
    for r in readers.values():
        count(r)
    e.sql("DELETE FROM customers WHERE key = 7")
    return spark.createDataFrame([(c, count(r)) for c, r in readers.items()], "consistency string, n long")


@query("write_back_outcomes", "SELECT * FROM (VALUES ('applied'), ('conflict'), ('rejected')) AS v(outcome)")
def write_back_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, store = loaded(spark, sf_dir)
    head = store.head()
    one = store.snapshot().where(F.get_json_object("body", "$.key") == "7")
    change = lambda body: one.select("id", F.lit("write").alias("op"), F.lit(body).alias("body"))
    first = e.submit("customers", change('{"key":7,"note":"a"}'), head)[0]
    return spark.createDataFrame([(x,) for x in (first, e.submit("customers", change('{"key":7,"note":"b"}'), head)[0], e.submit("customers", change('{"note":"c"}'), store.head())[0])], "outcome string")


@query("feed_frames", "SELECT seq, count(*) AS n, max(frame) > 0 AS cut FROM (SELECT event_id // 1000 AS seq, floor(coalesce(sum(strlen(props)) OVER (PARTITION BY event_id // 1000 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4096)::INT AS frame FROM events) GROUP BY 1")
def feed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("seq"), F.col("event_id").alias("id"), F.lit("write").alias("op"), F.col("props").alias("body"))
    return feed.frames(ops, 4096).groupBy("seq").agg(F.count(F.lit(1)).alias("n"), (F.max("frame") > 0).alias("cut"))
