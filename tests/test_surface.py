"""Statements and calls that the other modules leave out: definitions, paging, plans, fan-out, decisions, JSON paths, identity."""

import json
import uuid
from datetime import UTC, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.functions import json_text
from docloom.functions.identity import document_id
from docloom.operators import history, merge, search
from docloom.plans.syntax import SqlError
from docloom.session import SPACE, Engine
from docloom.streaming import feed


@pytest.fixture(scope="module")
def plain(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(f"k{i}", i, i % 3) for i in range(20)], "id string, n long, g long"), "id")
    return e


def test_definitions_change_the_lens_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.sql("INSERT INTO t (id, a, at) VALUES ('x', 'seven', '2024-01-02T03:04:05Z'), ('y', 7, 'never')")
    assert e.sql("SELECT a FROM t").dtypes == [("a", "string")]
    e.sql("CREATE TABLE t (a INT)")
    e.sql("ALTER TABLE t ADD COLUMN at TIMESTAMP")
    got = e.sql("SELECT a, at FROM t ORDER BY a")
    assert got.dtypes == [("a", "int"), ("at", "timestamp")] and [r["a"] for r in got.collect()] == [None, 7]  # a text is no INT
    e.sql("DROP TABLE t")
    assert e.sql("SELECT COUNT(*) AS n FROM t").first()["n"] == 2
    e.sql("CREATE INDEX i ON t (a)")
    for bad in ("CREATE INDEX i ON t (a)", "DROP INDEX nope ON t", "DROP VIEW nope"):
        with pytest.raises(SqlError):
            e.sql(bad)
    assert e.sql("EXPLAIN SELECT a FROM t WHERE a = 7").first()["plan"] == "index:eq"
    e.sql("DROP INDEX i ON t")
    assert e.sql("EXPLAIN SELECT a FROM t WHERE a = 7").first()["plan"] == "scan"


def test_filters_reach_the_scan(spark, sf):
    e = Engine(spark)
    e.register("lineitem", spark.read.parquet(f"{sf}/lineitem.parquet"))
    plan = e.sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "EqualTo(l_returnflag,R)" in plan and "l_tax" not in plan and "Python" not in plan
    top = e.sql("SELECT l_orderkey FROM lineitem ORDER BY l_extendedprice DESC LIMIT 5")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_limits(plain):
    assert plain.sql("SELECT id FROM t ORDER BY n LIMIT 3 OFFSET 18").count() == 2 and plain.sql("SELECT id FROM t LIMIT 0").count() == 0
    assert plain.sql("SELECT g, COUNT(*) AS c FROM t GROUP BY g LIMIT 2 OFFSET 1").collect()[0]["g"] == 1
    assert plain.sql("SELECT DISTINCT g FROM t LIMIT 2").count() == 2
    assert plain.sql("SELECT n + n AS x, n - 1 AS y FROM t WHERE n * n = 81").first().asDict() == {"x": 18, "y": 8}


def test_arithmetic_never_fails(plain):
    row = plain.sql("SELECT 9223372036854775807 + 1 AS over, 1 / 0 AS z, 1.0 / 0 AS r, 7 / -2 AS q, TRUE + 1 AS b, 'a' + 1 AS s FROM t LIMIT 1").first()
    assert tuple(row) == (None, None, None, -3, None, None)


def test_names_with_a_prefix(spark):
    e = Engine(spark, id_column="own_id", doc_column="own_doc", prefix="own_")
    e.register("d", spark.createDataFrame([("1", '{"a":{"b":[1,2]}}')], "own_id string, own_doc string"), "own_id", "own_doc")
    row = e.sql("SELECT own_id, own_json_get(own_doc, '$.a.b[1]') AS x, own_json_type(own_doc, '$.a') AS t FROM d").first()
    assert tuple(row) == ("1", "2", "object")


def test_paths():
    assert json_text.compile_path("$.a['x.y'][2]") == ["a", "x.y", 2] and json_text.compile_path("$.a[*].b", many=True)[1] is json_text.ALL
    for bad in ("a", "$.", "$[x]", "$.a[-2]", "$.a[*]"):
        with pytest.raises(json_text.PathError):
            json_text.compile_path(bad)
    with pytest.raises(json_text.PathError):
        json_text.compile_path("$[-1]", write=True)
    assert json_text.set_at({"a": 1, "b": 2}, ["a", "x"], 3) == {"a": {"x": 3}, "b": 2} and json_text.set_at([1], [1], 2) == [1, 2]
    assert json_text.delete_at({"a": {"x": 1, "y": 2}}, ["a", "x"]) == {"a": {"y": 2}} and json_text.delete_at({"a": 1}, ["b"]) == {"a": 1}
    assert json_text.equal({"a": [1, 2.0]}, {"a": [1.0, 2]}) and not json_text.equal(1, True) and not json_text.equal([1, 2], [2, 1])


def test_json_columns(spark):
    doc = spark.createDataFrame([('{"b":1,"a":{"c":[1,{"d":2}]},"s":"q","n":null}',)], "x string")
    x = F.col("x")
    row = doc.select(json_text.canonical(x), json_text.keys(x), json_text.kind(x, "$.n"), json_text.kind(x, "$.zz"), json_text.array_length(x, "$.a.c"), json_text.contains(x, "$.a.c", F.lit('{"d": 2.0}')), json_text.get(x, "$.s")).first()
    assert tuple(row)[0] == '{"a":{"c":[1,{"d":2}]},"b":1,"n":null,"s":"q"}' and set(json.loads(row[1])) == {"a", "b", "s", "n"}
    assert tuple(row)[2:5] == ("null", None, 2) and row[6] == '"q"'


def test_ids(spark):
    got = [r[0] for r in spark.createDataFrame([("order-1",), ("order-1",), ("6BA7B810-9DAD-11D1-80B4-00C04FD430C8",), (None,)], "g string").select(document_id(SPACE, F.col("g"))).collect()]
    assert got[0] == got[1] and uuid.UUID(got[0]).version == 8 and got[2] == "6ba7b810-9dad-11d1-80b4-00c04fd430c8" and uuid.UUID(got[3])
    with pytest.raises(PySparkException):
        spark.createDataFrame([("",)], "g string").select(document_id(SPACE, F.col("g"))).collect()


def test_ranks_over_buckets(spark):
    hits = spark.range(3000).select(F.col("id").cast("string").alias("id"), ((F.col("id") * 37) % 101).cast("float").alias("score"))
    want = [r["id"] for r in hits.orderBy(F.desc("score"), "id").collect()]
    got = {r["rank"]: r["id"] for r in search.ranked(hits).collect()}
    assert [got[i + 1] for i in range(3000)] == want


def test_fan_out(spark, tmp_path):
    spark.createDataFrame([(1, "c", "a", "write", '{"n":1}'), (1, "c", "b", "write", '{"n":5}')], "seq bigint, commit string, id string, op string, body string").write.parquet(str(tmp_path / "s/ops"))
    got: dict[str, list] = {"low": [], "all": []}
    n = F.get_json_object("body", "$.n").cast("int")
    sinks = {"low": (n < 3, lambda df, _: got["low"].extend((r["id"], r["op"]) for r in df.collect())), "all": (F.lit(True), lambda df, _: got["all"].extend((r["id"], r["op"]) for r in df.collect()))}
    q = feed.fan_out(feed.change_feed(spark, str(tmp_path / "s"), files_per_batch=10), sinks, str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert sorted(got["low"]) == [("a", "write"), ("b", "delete")] and sorted(got["all"]) == [("a", "write"), ("b", "write")]


def test_bootstrap_and_expiry(spark):
    old, new = (spark.createDataFrame(r, "id string, body string") for r in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert {tuple(r) for r in feed.bootstrap(old, new).collect()} == {("a", "delete", None), ("b", "write", "3"), ("c", "write", "4")}
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, tzinfo=UTC)), ("b", datetime(2024, 1, 3, tzinfo=UTC)), ("c", None)], "id string, until timestamp")
    now = F.lit("2024-01-02").cast("timestamp")
    assert sorted(r["id"] for r in history.visible(rows, "until", now).collect()) == ["b", "c"]
    assert [r["id"] for r in feed.sweep_expired(rows, "until", now).collect()] == ["a"]


def test_decisions(spark):
    c = spark.createDataFrame([(str(i), '{"a":0}', '{"a":1}', '{"a":2}') for i in range(5)], "id string, base string, local string, remote string")
    kinds = ["defer", "take", "doc", "fork", "delete"]
    got = {r["id"]: (r["kind"], r["doc"]) for r in merge.resolve(c, "custom", lambda r: {"kind": kinds[int(r["id"])], "doc": {"x": 1} if r["id"] in "23" else None}).collect()}
    assert got == {"0": ("defer", None), "1": ("take", '{"a":1}'), "2": ("doc", '{"x":1}'), "3": ("fork", '{"x":1}'), "4": ("delete", None)}
    with pytest.raises(PySparkException):
        merge.resolve(c, "custom", lambda r: {"kind": "guess"}).collect()
    with pytest.raises(ValueError):
        merge.resolve(c, "nope")


def test_rebase_keeps_both_sides(spark):
    rows = [('{"a":1,"b":1}', '{"a":2,"b":1,"n":9}', '{"a":1,"b":3}'), ('{"a":1}', "{}", '{"a":1,"z":1}'), ('{"a":1}', '{"a":2}', '{"a":3}'), (None, '{"a":1}', '{"a":1.0}')]
    df = spark.createDataFrame(rows, "b string, l string, r string")
    assert [r[0] for r in df.select(merge.rebase("b", "l", "r")).collect()] == ['{"a":2,"b":3,"n":9}', '{"z":1}', None, '{"a":1}']
