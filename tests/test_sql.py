"""Semantics of the dialect over JSON documents, against a row-at-a-time evaluator written from the rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.plans import syntax as S
from docloom.plans.syntax import SqlError
from docloom.session import BoundError, Engine

DOCS = [
    {"title": "Deploy the thing", "status": "open", "priority": 3, "tags": ["db", "ops"], "people": [{"id": "u1"}, {"id": "u2"}], "flag": True, "score": 2.5},
    {"title": "lower case", "status": "done", "priority": None, "tags": [], "people": [{"id": "u3"}], "flag": False, "score": "high"},
    {"title": "Third", "status": "open", "priority": 1, "tags": ["db"], "score": 7},
    {"title": "Four\\th", "status": "held", "priority": 2, "tags": ["x", "ops", "db"], "people": [], "flag": True},
    {"title": "Fifth%", "status": "open", "priority": 3, "nested": {"a": [[{"b": 9}], {"b": 1}]}, "score": 1},
]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    rows = [(f"d{i}", json.dumps(d)) for i, d in enumerate(DOCS, 1)]
    e.register("docs", spark.createDataFrame(rows, "_id string, _doc string"), "_id", "_doc")
    e.register("users", spark.createDataFrame([("u1", "Ann"), ("u3", "Cy")], "uid string, name string"), "uid")
    return e


def ids(engine, where, params=()):
    return sorted(r[0] for r in engine.sql(f"SELECT _id FROM docs WHERE {where}", params).collect())


@pytest.mark.parametrize(
    "where, want",
    [
        ("tags = 'db'", [1, 3, 4]), ("NOT (tags = 'db')", [2, 5]), ("tags <> 'db'", [1, 4]), ("people.id = 'u2'", [1]), ("people.id IN ('u2', 'u3')", [1, 2]),
        ("priority > 1", [1, 4, 5]), ("NOT priority > 1", [2, 3]), ("priority IS NULL", [2]), ("priority IS NOT MISSING", [1, 2, 3, 4, 5]), ("flag IS MISSING", [3, 5]),
        ("flag", [1, 4]), ("NOT flag", [2, 3, 5]), ("flag = 1", [1, 4]), ("score > 1", [1, 3]), ("score = 'high'", [2]), ("score <> 7", [1, 2, 5]), ("score BETWEEN 1 AND 3", [1, 5]),
        ("title LIKE '%th%'", [1, 4, 5]), ("title LIKE 'Four\\th'", [4]), ("title ILIKE 'LOWER%'", [2]), ("title NOT LIKE '%e%'", [3, 4, 5]), ("title LIKE 'Fifth_'", [5]),
        ("nested.a.b = 9", [5]), ("nested.a.b = 1", [5]), ("ARRAY_CONTAINS(tags, 'db', 'ops')", [1, 4]), ("ARRAY_CONTAINS_ANY(tags, 'x', 'ops')", [1, 4]), ("ARRAY_LENGTH(tags) = 0", [2]),
        ("EXISTS(people)", [1, 2, 4]), ("priority + 1 = 4", [1, 5]), ("priority / 2 = 1", [1, 4, 5]), ("flag + 1 = 2", [1, 4]), ("1", [1, 2, 3, 4, 5]), ("FALSE", []), ("status = NULL", []),
        ("COALESCE(priority, 9) = 9", [2]), ("status IN ('open') AND (priority = 3 OR score = 7)", [1, 3, 5]), ("CASE WHEN flag THEN 1 ELSE 2 END = 1", [1, 4]),
    ],
)
def test_predicates(engine, where, want):
    assert ids(engine, where) == [f"d{i}" for i in want]


def test_parameters(engine):
    assert ids(engine, "priority = ? AND status = ?", [3, "open"]) == ["d1", "d5"]
    assert ids(engine, "status = ?") == []  # a parameter that is not given is NULL


def test_projection_and_order(engine):
    rows = engine.sql("SELECT _id, tags, people.id, priority AS p, missing FROM docs ORDER BY p DESC, _id LIMIT 2").collect()
    assert [tuple(r) for r in rows] == [("d1", '["db","ops"]', "u1", "3", None), ("d5", None, None, "3", None)]
    order = [r[0] for r in engine.sql("SELECT _id FROM docs ORDER BY score").collect()]
    assert order == ["d4", "d5", "d1", "d3", "d2"]  # null, numbers, strings
    assert [r[0] for r in engine.sql("SELECT _id FROM docs ORDER BY score DESC").collect()] == order[::-1]
    assert engine.sql("SELECT priority FROM docs", infer_types=True).dtypes == [("priority", "bigint")]


def test_groups(engine):
    rows = engine.sql("SELECT status, COUNT(*) AS n, SUM(priority) AS s, AVG(priority), MIN(score), MAX(score) FROM docs GROUP BY status").collect()
    assert [tuple(r) for r in rows] == [("done", 1, None, None, "high", "high"), ("held", 1, "2", 2.0, None, None), ("open", 3, "7", 7 / 3, "1", "7")]
    assert engine.sql("SELECT SUM(score) + 1 AS x, COUNT(score) AS n FROM docs LIMIT 0").collect()[0].asDict() == {"x": "11.5", "n": 4}
    e = [tuple(r) for r in engine.sql("SELECT priority, COUNT(*) FROM docs GROUP BY priority ORDER BY COUNT(*) DESC, priority").collect()]
    assert e == [("3", 2), (None, 1), ("1", 1), ("2", 1)]


def test_distinct_keeps_the_first(engine):
    assert [r[0] for r in engine.sql("SELECT DISTINCT status FROM docs ORDER BY priority DESC, _id").collect()] == ["open", "held", "done"]


def test_joins(engine):
    rows = engine.sql("SELECT d._id AS id, u.name AS n FROM docs d JOIN users u ON d.people.id = u.uid WHERE u.name <> 'x' ORDER BY d._id").collect()
    assert [tuple(r) for r in rows] == [("d1", "Ann"), ("d2", "Cy")]


def test_all_values(engine):
    assert [r[0] for r in engine.sql("SELECT ALL_VALUES(people.id) FROM docs ORDER BY _id").collect()] == ['["u1","u2"]', '["u3"]', "[]", "[]", "[]"]


def test_bound_is_an_error(spark, engine):
    small = Engine(spark, max_rows=3)
    small.collections = engine.collections
    with pytest.raises(BoundError):
        small.sql("SELECT _id FROM docs")
    assert small.sql("SELECT _id FROM docs LIMIT 3").count() == 3


@pytest.mark.parametrize("bad", ["SELECT nope.x FROM users", "SELECT x(1) FROM docs", "SELECT _id FROM docs WHERE COUNT(*) = 1", "SELECT title, COUNT(*) FROM docs GROUP BY status", "SELECT SUM(COUNT(*)) FROM docs", "SELECT * FROM docs GROUP BY status", "SELECT * ", "SELECT _id FROM docs ORDER BY COUNT(*)", "SELECT a FROM nowhere"])
def test_analysis_errors(engine, bad):
    with pytest.raises(SqlError):
        engine.sql(bad)


def test_views_and_explain(engine):
    engine.sql("CREATE VIEW open_docs AS SELECT _id AS id, priority AS p FROM docs WHERE status = 'open'")
    assert engine.sql("SELECT COUNT(*) AS n FROM open_docs WHERE p = '3'").first()["n"] == 2
    engine.sql("DROP VIEW open_docs")
    row = engine.sql("EXPLAIN ANALYZE SELECT title FROM docs WHERE _id = 'd1'").first()
    assert (row["plan"], row["rows"], row["rows_examined"]) == ("keylookup", 1, 5)


def test_pages(engine):
    page, more = engine.page("SELECT title FROM docs", 2)
    seen, after = [r[0] for r in page.collect()], more.first()
    while after:
        page, more = engine.page("SELECT title FROM docs", 2, after["after"])
        seen += [r[0] for r in page.collect()]
        after = more.first()
    assert seen == [d["title"] for d in DOCS]


# ---- randomised, against plain Python


def reach(v, parts):
    if not parts:
        return [v]
    if isinstance(v, list):
        return [x for e in v for x in reach(e, parts)]
    return reach(v[parts[0]], parts[1:]) if isinstance(v, dict) and parts[0] in v else []


def opened(v):
    return v if isinstance(v, list) else [v]


def rank(v):
    return 0 if v is None else 1 if isinstance(v, bool | int | float) else 2 if isinstance(v, str) else 3


def compare(op, a, b):
    if a is None or b is None:
        return False
    if rank(a) != rank(b):
        return op == "<>"
    x, y = (float(a), float(b)) if rank(a) == 1 else (a, b) if rank(a) == 2 else (json.dumps(a, sort_keys=True), json.dumps(b, sort_keys=True))
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def holds(e, doc):
    if isinstance(e, S.Not):
        return not holds(e.inner, doc)
    if e.op in ("AND", "OR"):
        return holds(e.left, doc) and holds(e.right, doc) if e.op == "AND" else holds(e.left, doc) or holds(e.right, doc)
    return any(compare(e.op, x, e.right.value) for v in reach(doc, e.left.path.split(".")) for x in opened(v))


def test_random_predicates(spark):
    rng = random.Random(11)
    scalar = lambda: rng.choice([None, True, False, 0, 1, 2, 1.0, 2.5, "a", "b", "1"])
    value = lambda d: [value(d - 1) for _ in range(rng.randint(0, 3))] if d and rng.random() < 0.3 else {"b": value(d - 1)} if d and rng.random() < 0.4 else scalar()
    docs = [{k: value(2) for k in ("a", "c") if rng.random() < 0.85} for _ in range(120)]
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(f"{i:03}", json.dumps(d)) for i, d in enumerate(docs)], "_id string, _doc string"), "_id", "_doc")
    quoted = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    test = lambda: f"{rng.choice(['a', 'a.b', 'c'])} {rng.choice(['=', '<>', '<', '>=', '>'])} {quoted(scalar())}"
    wheres = [f"{rng.choice(['', 'NOT '])}({test()}) {rng.choice(['AND', 'OR'])} {rng.choice(['', 'NOT '])}({test()})" for _ in range(8)]
    for w in wheres:
        tree = S.parse_filter(w)
        assert ids_of(e, w) == [f"{i:03}" for i, d in enumerate(docs) if holds(tree, d)], w


def ids_of(e, w):
    return sorted(r[0] for r in e.sql(f"SELECT _id FROM t WHERE {w}").collect())


def test_arrays_in_arrays_of_any_depth(spark):
    def deep(value, n):
        return value if n == 0 else [deep(value, n - 1), n]

    e = Engine(spark)
    rows = [(n, json.dumps({"a": deep({"b": n}, n), "c": deep("x", n)})) for n in (0, 1, 3, 4, 7, 60)] + [(99, json.dumps({"a": [[[[[], [[{"b": [[[[5]]]]}]]]]], {"b": 4}]})), (100, '{"a": [[[[[[]]]]]]}')]
    e.register("deep", spark.createDataFrame(rows, "_id long, _doc string"), "_id", "_doc")
    found = lambda where: sorted(r[0] for r in e.sql(f"SELECT _id FROM deep WHERE {where}").collect())
    assert [found(f"a.b = {n}") for n in (0, 1, 3, 4, 7, 60)] == [[0], [1], [3], [4, 99], [7], [60]]
    # On the way arrays are opened however deep, at the end of the path once.
    assert found("c = 'x'") == [0, 1] and found("a = 60") == [60] and found("a = 7") == [7] and found("a.b = 5") == []
    assert {r[0]: json.loads(r[1]) for r in e.sql("SELECT _id, ALL_VALUES(a.b) FROM deep WHERE _id > 50").collect()} == {60: [60], 99: [[[[5]]], 4], 100: []}


def test_arrays_at_the_end_of_a_path(spark):
    """Declared and undeclared nested arrays alike: the last array is opened once."""
    rows = [(1, [[1, 2], [3]], [[[{"y": 5}]], [[{"y": 6}]]]), (2, [[4]], None), (3, None, [[[]]])]
    typed = spark.createDataFrame(rows, "_id long, x array<array<long>>, d array<array<array<struct<y: long>>>>")
    e = Engine(spark)
    e.register("t", typed)
    e.register("u", typed.select("_id", F.to_json(F.struct("x", "d")).alias("_doc")), "_id", "_doc")
    for t in "tu":
        found = lambda where: sorted(r[0] for r in e.sql(f"SELECT _id FROM {t} WHERE {where}").collect())  # noqa: B023, E731
        assert [found("x = 1"), found("x = 4"), found("x > 0"), found("d.y = 6"), found("d.y > 4 AND d.y < 6"), found("x = '[4]'")] == [[], [], [], [1], [1], []], t
    e.register("v", spark.createDataFrame([(1, '{"x":[[1,2]],"z":[1]}')], "_id long, _doc string"), "_id", "_doc")
    assert e.sql("SELECT _id FROM v WHERE x = 1").count() == 0 and e.sql("SELECT _id FROM v WHERE z = 1").count() == 1
