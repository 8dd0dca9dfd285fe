import json
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.functions import cells
from docloom.operators import constraints, merge
from docloom.operators.access import AccessError
from docloom.plans.syntax import ColumnDef, SqlError
from docloom.session import ConstraintError, Engine
from docloom.sources import indexes
from docloom.sources.log import Files, Log, decide
from docloom.sources.store import ConflictError, RevisionError, Store
from docloom.streaming import feed


def docs(df):
    return {r["id"]: json.loads(r["body"]) for r in df.collect()}


def ops(spark, *rows):
    return spark.createDataFrame(rows, "id string, op string, body string")


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    for day, rows in ((1, [("a", "write", '{"n":1}'), ("b", "write", '{"n":2}')]), (2, [("a", "write", '{"n":10}'), ("c", "write", '{"n":3}')]), (3, [("b", "delete", None)])):
        s.commit(ops(spark, *rows), f"day {day}", ts=datetime(2024, 1, day, tzinfo=UTC))
    return s


def test_revisions(spark, store, tmp_path):
    store.tag("v1", "head~2")
    store.branch("dev", "head^")
    assert docs(store.snapshot()) == {"a": {"n": 10}, "c": {"n": 3}}
    assert docs(store.snapshot("tag:v1")) == docs(store.snapshot("head~2")) == {"a": {"n": 1}, "b": {"n": 2}}
    assert set(docs(store.snapshot("branch:dev"))) == {"a", "b", "c"}
    assert set(docs(store.snapshot(store.resolve("head")[:8] + "~1"))) == {"a", "b", "c"}
    assert docs(store.snapshot(at=datetime(2024, 1, 2, 12, tzinfo=UTC))) == docs(store.snapshot("head~1"))
    assert docs(store.snapshot(at=datetime(2023, 1, 1, tzinfo=UTC))) == {}
    for bad in ("nope", "head~9", "tag:x", "~1", "zz"):
        with pytest.raises(RevisionError):
            store.resolve(bad)
    again = Store(spark, str(tmp_path / "t"))
    assert again.refs == store.refs and again.commits.keys() == store.commits.keys()
    assert [r["message"] for r in store.log(limit=2).collect()] == ["day 3", "day 2"]


def test_writes_are_dealt(spark, tmp_path):
    """A source in one piece is checked and kept in many, each document in one of them."""
    e = Engine(spark, str(tmp_path / "e"))
    e.sql("CREATE TABLE t (k BIGINT NOT NULL UNIQUE)")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        e.put("t", spark.range(400).coalesce(1).select(F.format_string('{"id":"d%d","k":%d}', "id", "id").alias("body")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = e.collection("t").store.snapshot().withColumn("file", F.input_file_name())
    assert kept.select("file").distinct().count() == 4 and kept.select("id").distinct().count() == 400
    with pytest.raises(ConstraintError):
        e.put("t", spark.range(3).coalesce(1).select(F.lit('{"k":"x"}').alias("body")))


def test_types_are_checked_without_cells(spark):
    """What a declared type takes, for every kind of value; the text of an object is not made for it, and one name is looked up without a list."""
    values = ["1", "1.0", "1.5", "2147483648", "-2147483648", "9223372036854775807", "9223372036854775808", "1e300", "true", '"x"', '"2024-01-02T03:04:05Z"', '"00000000-0000-4000-8000-00000000000A"', '{"a":[1]}', "[]", "null"]
    takes = {
        "string": {9, 10, 11}, "int": {0, 1, 4}, "bigint": {0, 1, 3, 4}, "double": {*range(8)}, "boolean": {8}, "timestamp": {10}, "uuid": {11}, "object": {12}, "array": {13}, "enum": {9},
    }
    docs = spark.createDataFrame([(i, f'{{"k":{v}}}') for i, v in enumerate(values)] + [(15, "{}")], "i int, body string")
    fit = {kind: constraints.fits(cells.first(F.try_parse_json("body"), ["k"]), kind, ("x",)) for kind in takes}
    assert not any("to_json" in str(c) or "filter" in str(c) for c in fit.values())
    rows = docs.select("i", *[c.alias(kind) for kind, c in fit.items()]).collect()
    assert {kind: {r["i"] for r in rows if r[kind]} for kind in takes} == {kind: own | {14, 15} for kind, own in takes.items()}


def test_first_is_the_first_of_walk(spark):
    docs = spark.createDataFrame([(b,) for b in ('{"a":1}', '{"a":null}', '{"a":[1,2]}', '{"a":{"b":1}}', '{"a":[{"b":[2]},{"b":3}]}', '{"it is":{"b":4}}', "{}", "7", None)], "body string")
    v = F.try_parse_json("body")
    for path in (["a"], ["a", "b"], ["it is"], ["it is", "b"]):
        got = docs.select(F.to_json(cells.first(v, path)).alias("x"), F.to_json(F.get(F.slice(cells.walk(v, path), 1, 1), F.lit(0))).alias("y")).collect()
        assert all(r["x"] == r["y"] for r in got) and any(r["x"] is not None for r in got)


def test_declared_fields_are_read_from_one_parse(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.sql("CREATE TABLE t (a BIGINT, b DOUBLE, c VARCHAR)")
    e.put("t", spark.createDataFrame([('{"id":"x","a":1,"b":1.5,"c":"y"}',), ('{"id":"z","a":2,"b":3}',)], "body string"))
    read = e.sql("SELECT a, b, c FROM t")
    assert read._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 1
    assert {tuple(r) for r in read.collect()} == {(1, 1.5, "y"), (2, 3.0, None)}


def test_cells_of_keys_are_made_once(spark):
    """A key asks its cell many times; a claim makes it once, and an index does so after one look for an array."""
    claim, keys = constraints.claim(F.col("body"), ("k",)), indexes.keys(F.try_parse_json("body"), "k")
    assert str(claim).count("schema_of_variant") == 1 and str(keys).count("schema_of_variant") == 2
    docs = spark.createDataFrame([(b,) for b in ('{"k":1}', '{"k":1.0}', '{"k":true}', '{"k":"1"}', '{"k":[1]}', '{"k":{"a":1}}', '{"k":1.5}', '{"k":null}', "{}")], "body string")
    one, *rest = [r[0] for r in docs.select(claim).collect()]
    assert rest[:2] == [one, one] and len({one, *rest[2:6]}) == 5 and rest[6:] == [None, None]
    found = [r[0] for r in docs.select(F.transform(keys, lambda x: F.struct(x["r"], x["d"], x["s"]))).collect()]
    assert [[tuple(x) for x in r] for r in found] == [[(1, 1.0, None)], [(1, 1.0, None)], [(1, 1.0, None)], [(2, None, "1")], [(1, 1.0, None)], [(3, None, '{"a":1}')], [(1, 1.5, None)], [(0, None, None)], []]


def test_conflicts_are_looked_for_once(engine, monkeypatch):
    """Also where documents claim nothing, which never meet."""
    seen = []
    kept = Engine._kept
    monkeypatch.setattr(Engine, "_kept", staticmethod(lambda c, df: seen.append(df.columns) or kept(c, df)))
    n = engine.sql("SELECT COUNT(*) FROM t").first()[0]
    engine.sql("CREATE TABLE t (k BIGINT, name VARCHAR)")
    engine.sql("INSERT INTO t (name) VALUES ('none') ON CONFLICT (k) DO NOTHING")
    engine.sql("INSERT INTO t (name) VALUES ('none') ON CONFLICT (k) DO UPDATE SET name = 'hit'")
    engine.sql("INSERT INTO t (k, name) VALUES (1, 'x'), (77, 'new') ON CONFLICT (k) DO UPDATE SET name = 'hit'")
    found = [r[0] for r in engine.sql("SELECT name FROM t").collect()]
    assert len(seen) == 3 and len(found) == n + 3 and found.count("none") == 2 and found.count("hit") == found.count("new") == 1


def test_diff_history_revert(store):
    assert {tuple(r) for r in store.diff("head~2", "head").collect()} == {("a", "modified"), ("b", "removed"), ("c", "added")}
    assert [(r["version"], r["op"]) for r in store.history("b").collect()] == [(1, "write"), (2, "delete")]
    store.revert("head~2")
    assert docs(store.snapshot()) == {"a": {"n": 1}, "b": {"n": 2}}


def test_ancestry_and_compaction(spark, store):
    old, new = store.resolve("head~2"), store.resolve("head")
    store.branch("dev", "head~1")
    store.commit(ops(spark, ("d", "write", "{}")), branch="dev")
    assert store.is_ancestor(old, new) and not store.is_ancestor(new, old)
    assert store.common_ancestor(store.resolve("dev"), new) == store.resolve("head~1")
    assert [c.message for c in store.commits_since(old, new)] == ["day 2", "day 3"]
    assert set(docs(store.snapshot("dev"))) == {"a", "b", "c", "d"}
    store.compact("head~1")
    assert docs(store.snapshot()) == {"a": {"n": 10}, "c": {"n": 3}}
    with pytest.raises(RevisionError):
        store.resolve("head~2~1")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.sql("CREATE TABLE t (k BIGINT NOT NULL UNIQUE, name VARCHAR)")
    e.sql("INSERT INTO t (id, k, name, tags.first) VALUES ('one', 1, 'Ann', 'x'), ('two', 2, 'Bob', NULL)")
    return e


def rows(e, text):
    return [tuple(r) for r in e.sql(text).collect()]


def test_insert_update_delete(engine):
    assert rows(engine, "SELECT k, name, tags.first FROM t ORDER BY k") == [(1, "Ann", "x"), (2, "Bob", None)]
    w = engine.sql("UPDATE t SET k = k + 10, name = 'Zed' REMOVE tags WHERE name = 'Ann' RETURNING k, name")
    assert w.rows == 1 and [tuple(r) for r in w.returned.collect()] == [("11", "Zed")]
    engine.sql("DELETE FROM t WHERE k = 2")
    assert rows(engine, "SELECT k, name, tags FROM t") == [(11, "Zed", None)]
    assert rows(engine, "SELECT COUNT(*) FROM t AT COMMIT 'head~2'") == [(2,)]
    first = engine.get("t", engine.collection("t").store.snapshot().first()["id"]).first()
    assert list(json.loads(first["_doc"])) == ["id", "k", "name"]  # key order stays


def test_upsert(engine):
    engine.sql("INSERT INTO t (k, name) VALUES (1, 'no'), (3, 'new') ON CONFLICT (k) DO NOTHING")
    engine.sql("INSERT INTO t (k, name) VALUES (2.0, 'no') ON CONFLICT (k) DO UPDATE SET name = 'hit' WHERE name = 'Bob'")
    assert rows(engine, "SELECT k, name FROM t ORDER BY k") == [(1, "Ann"), (2, "hit"), (3, "new")]


def test_constraints(engine):
    for bad in ("INSERT INTO t (k) VALUES (1)", "INSERT INTO t (name) VALUES ('x')", "INSERT INTO t (k) VALUES ('x')", "UPDATE t SET k = 1"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    assert rows(engine, "SELECT COUNT(*) FROM t") == [(2,)]


def test_transactions(engine):
    engine.sql("BEGIN")
    engine.sql("INSERT INTO t (k) VALUES (5)")
    assert rows(engine, "SELECT COUNT(*) FROM t") == [(3,)]
    engine.sql("ROLLBACK")
    assert rows(engine, "SELECT COUNT(*) FROM t") == [(2,)]
    engine.sql("BEGIN")
    engine.sql("UPDATE t SET name = 'q' WHERE k = 1")
    engine.sql("DELETE FROM t WHERE k = 2")
    engine.sql("COMMIT")
    assert rows(engine, "SELECT k, name FROM t") == [(1, "q")] and len(engine.collection("t").store.commits) == 2
    with pytest.raises(SqlError):
        engine.sql("COMMIT")


def test_checkout_and_merge(engine):
    store = engine.collection("t").store
    store.branch("dev")
    a, b = (r["id"] for r in store.snapshot().orderBy("body").collect())
    put = lambda i, d, branch: store.commit(ops(engine.spark, (i, "write", json.dumps(d))), branch=branch)
    put(a, {"k": 1, "name": "Ann", "x": 1}, "dev")
    put(a, {"k": 1, "name": "Amy"}, "main")
    put(b, {"k": 2, "name": "dev"}, "dev")
    commit, deferred = engine.merge("t", "dev", policy="strict")
    assert commit is not None and len(commit.parents) == 2
    got = {d["k"]: d for d in docs(store.snapshot()).values()}
    assert got[1]["name"] == "Amy" and got[1]["x"] == 1 and got[2]["name"] == "dev"
    engine.checkout("t", "head^")
    assert "dev" not in [r[0] for r in rows(engine, "SELECT name FROM t")]
    with pytest.raises(SqlError):
        engine.sql("DELETE FROM t")


def test_policies(spark):
    c = spark.createDataFrame([("1", '{"a":1,"b":1}', '{"a":2,"b":1}', '{"a":1,"b":3}'), ("2", '{"a":1}', '{"a":2}', '{"a":3}')], "id string, base string, local string, remote string")
    out = lambda p, f=None: {r["id"]: (r["kind"], r["doc"]) for r in merge.resolve(c, p, f).collect()}
    assert out("strict") == {"1": ("doc", '{"a":2,"b":3}'), "2": ("defer", None)}
    assert out("last_write")["2"] == ("take", '{"a":2}') and out("append_only")["1"][0] == "defer"
    add = lambda r: {"kind": "doc", "doc": {"a": r["local"]["a"] + r["remote"]["a"] - r["base"]["a"]}}
    assert out("custom", add)["2"] == ("doc", '{"a":4}')


def test_three_way_fields():
    got = merge.field_changes({"a": 1, "n": {"x": 1, "y": [1]}, "gone": 1}, {"a": 2, "n": {"x": 1, "y": [1, 2]}, "gone": 1}, {"a": 3, "n": {"x": 5, "y": [1, 2]}})
    assert [(c["path"], c["side"]) for c in got] == [("/a", "both"), ("/gone", "remote"), ("/n/x", "remote"), ("/n/y", "same")]


def test_schema_steps():
    s = constraints.Schema((ColumnDef("a", "int"),))
    t = constraints.migrate(s, [("add_field", "b", ColumnDef("b", "string", True)), ("rename_field", "a", "z"), ("change_type", "z", "bigint"), ("widen_enum", "b", ("x", "y"))])
    assert t.names() == ["z", "b"] and t.version == 5 and dict(t.enums) == {"b": ("x", "y")}
    assert constraints.is_breaking(("add_field", "b", ColumnDef("b", "string", True))) and not constraints.is_breaking(("widen_enum", "b", ("x",)))
    assert ("add_field", "b", t.fields[1]) in constraints.schema_diff(s, t)
    with pytest.raises(ValueError):
        constraints.migrate(s, [("drop_field", "nope")])


def test_feed(spark, store, tmp_path):
    out = str(tmp_path / "out")
    view = feed.filtered(feed.change_feed(spark, store.path, after=1), F.get_json_object("body", "$.n").cast("int") > 5)

    def run():
        q = view.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted((r["seq"], r["id"], r["op"]) for r in spark.read.parquet(out).collect())

    first = run()
    assert first == [(2, "a", "write"), (2, "c", "delete"), (3, "b", "delete")]
    store.commit(ops(spark, ("z", "write", '{"n":6}')))
    assert run() == [*first, (4, "z", "write")]  # goes on where it stopped


def test_desync(spark, tmp_path):
    kinds = "namespace string, seq int, commit string, parent string"
    rows = spark.createDataFrame([("n", 1, "a", ""), ("n", 2, "b", "a"), ("n", 3, "d", "c")], kinds)
    assert [tuple(r) for r in feed.desync(rows).collect()] == [("n", "d", "b")]
    rows.write.parquet(str(tmp_path / "in"))
    q = feed.desync(spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bad").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("bad").collect()] == [("n", "d", "b")]


def test_attachments(engine):
    engine.sql("INSERT INTO t (id, k) VALUES ('f', 7) WITH ATTACHMENT 'a.txt' = X'6869' MIME 'text/plain', ATTACHMENT FROM_BASE64('AAEC')")
    got = "SELECT ATTACHMENT_COUNT() AS n, ATTACHMENT_SIZE('a.txt') AS s, ATTACHMENT_MIME('a.txt') AS m, ATTACHMENT('a.txt') AS c FROM t WHERE k = 7"
    assert rows(engine, got) == [(2, 2, "text/plain", b"hi")]
    engine.sql("UPDATE t SET ATTACHMENT 'a.txt' = X'68657921', RENAME ATTACHMENT 'nope' TO 'x' WHERE k = 7")
    assert rows(engine, got)[0][1] == 4
    engine.sql("UPDATE t RENAME ATTACHMENT 'a.txt' TO 'b.txt' WHERE k = 7")
    assert rows(engine, got) == [(2, None, None, None)] and rows(engine, "SELECT ATTACHMENT('b.txt') FROM t WHERE k = 7") == [(b"hey!",)]
    engine.sql("UPDATE t DROP ATTACHMENT 'b.txt' WHERE k = 7")
    assert rows(engine, got)[0][0] == 1 and rows(engine, got + " AT COMMIT 'head~1'")[0][0] == 2
    assert rows(engine, "SELECT ATTACHMENT_COUNT() FROM t WHERE k = 1") == [(0,)]


def test_preconditions_and_sweep(spark, engine):
    import hashlib

    store = engine.collection("t").store
    one = store.snapshot().where("body LIKE '%Ann%'").first()
    new = ops(spark, (one["id"], "write", '{"k":1,"until":"2024-01-01T00:00:00Z"}'))
    expect = lambda h: spark.createDataFrame([(one["id"], h)], "id string, hash string")
    for bad in (None, "0" * 64):
        with pytest.raises(ConstraintError):
            engine.write_if("t", new, expect(bad))
    engine.write_if("t", new, expect(hashlib.sha256(one["body"].encode()).hexdigest()))
    assert engine.sweep("t", "until", datetime(2024, 2, 1)).rows == 1
    assert rows(engine, "SELECT k FROM t") == [(2,)]


def test_subscription(spark, engine, tmp_path):
    q = engine.subscribe("t", "name = 'Ann' AND tags.first LIKE 'x%'").writeStream.format("memory").queryName("sub").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(r["op"] for r in spark.table("sub").collect()) == ["delete", "write"]


# ---- several writers, crashes, retention


def test_dead_commits_stay_dead(spark, store, tmp_path):
    """A writer that died before its log entry leaves nothing; one that died behind it has committed."""
    store.stage(ops(spark, ("ghost", "write", "{}")))
    store.commit(ops(spark, ("d", "write", "{}")))
    again = Store(spark, str(tmp_path / "t"))
    assert set(docs(again.snapshot())) == {"a", "c", "d"} and again.operations().where("id = 'ghost'").count() == 0
    moved = again.files.move
    again.files.move = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        again.commit(ops(spark, ("e", "write", "{}")))
    again.files.move = moved
    assert set(docs(Store(spark, str(tmp_path / "t")).snapshot())) == {"a", "c", "d", "e"}


def test_two_writers(spark, store, tmp_path):
    other = Store(spark, str(tmp_path / "t"))
    head = store.head()
    store.commit(ops(spark, ("x", "write", "{}"), ("a", "write", '{"n":11}')), expected=head)
    other.commit(ops(spark, ("y", "write", "{}")), expected=head)  # other documents: goes on top
    with pytest.raises(ConflictError):
        other.commit(ops(spark, ("a", "write", '{"n":12}')), expected=head)
    with pytest.raises(ConflictError):
        other.commit(ops(spark, ("q", "write", "{}")), expected=head, exclusive=True)
    store.refresh()
    assert docs(store.snapshot()) == docs(other.snapshot()) == docs(Store(spark, store.path).snapshot()) == {"a": {"n": 11}, "c": {"n": 3}, "x": {}, "y": {}}
    assert [r["seq"] for r in store.log().collect()] == [5, 4, 3, 2, 1]
    assert sorted((r["seq"], r["id"]) for r in store.operations().where("seq > 3").collect()) == [(4, "a"), (4, "x"), (5, "y")]
    with pytest.raises(ValueError):
        store.commit(ops(spark, ("z", "write", "{}"), ("z", "delete", None)))


def test_create_is_exclusive(spark, tmp_path):
    files = Files(spark)
    for make in (files.create, lambda at, text: files._renamed(f"{at}.own", at, text)):  # by a link, and as on other file systems
        at = str(tmp_path / f"f{make.__name__.strip('<>')}")
        assert make(at, "one ü") and not make(at, "two") and files.read(at) == "one ü"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create(str(tmp_path / "race"), str(i)), range(8)))
    assert sum(won) == 1 and files.read(str(tmp_path / "race")) == str(won.index(True)) and not [n for n in files.names(str(tmp_path)) if n.startswith(".new")]


def test_states_of_a_long_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Log, "STATE_EVERY", 4)
    s = Store(spark, str(tmp_path / "t"))
    s.commit(ops(spark, ("a", "write", "{}")), ts=datetime(2024, 1, 1, tzinfo=UTC))
    for i in range(7):
        s.tag(f"t{i}")
    lease = s.lease("job", "me", 3600)
    s.define(lambda _: {"x": 1})
    again = Store(spark, str(tmp_path / "t"))
    assert s.record.newest_state()[0] == 8
    assert (again.commits, again.refs, again.leases, again.catalog, again.at) == (s.commits, s.refs, {"job": lease}, {"x": 1}, 10)


def test_compaction_keeps_attachments(engine):
    engine.sql("INSERT INTO t (id, k) VALUES ('f', 7) WITH ATTACHMENT 'a.txt' = X'6869' MIME 'text/plain', ATTACHMENT 'gone' = X'00'")
    engine.sql("UPDATE t DROP ATTACHMENT 'gone' WHERE k = 7")
    store = engine.collection("t").store
    before, documents = sorted(map(tuple, store.attachments().collect())), docs(store.snapshot())
    store.compact("head")
    for s in (store, Store(engine.spark, store.path)):
        assert sorted(map(tuple, s.attachments().collect())) == before and len(before) == 1 and docs(s.snapshot()) == documents
    engine.sql("UPDATE t SET ATTACHMENT 'b' = X'01' WHERE k = 7")
    engine.sql("UPDATE t SET name = 'new' WHERE k = 1")
    store.compact("head")
    assert rows(engine, "SELECT ATTACHMENT_COUNT() AS n, ATTACHMENT('a.txt') AS c FROM t WHERE k = 7") == [(2, b"hi")] and len(store.commits) == 1
    assert store.files.names(f"{store.path}/ops") == [] and len(store.files.names(f"{store.path}/folded")) == 1


def test_retention(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    for hour in range(0, 96, 8):
        s.commit(ops(spark, (f"d{hour % 3}", "write", json.dumps({"h": hour}))), ts=datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=hour))
    s.tag("mark", "head~10")
    s.branch("side", "head~6")
    s.commit(ops(spark, ("side", "write", "{}")), branch="side", ts=datetime(2024, 1, 2, 20, tzinfo=UTC))
    now = datetime(2024, 1, 5, tzinfo=UTC)
    kept = [c.id for c in sorted(s.commits.values(), key=lambda c: c.seq)]
    was = {c: docs(s.snapshot(c)) for c in kept}
    gone = s.retain([(timedelta(hours=36), "daily"), (timedelta(hours=80), "tagged")], now)
    assert 0 < len(gone) < len(kept) and all(s.refs[x] not in gone for x in s.refs)
    again = Store(spark, str(tmp_path / "t"))
    assert set(again.commits) == set(kept) - set(gone) and all(docs(again.snapshot(c)) == was[c] for c in again.commits)
    assert s.common_ancestor(s.resolve("side"), s.resolve("head")) == s.resolve("side^")
    young = [c for c in kept if now - s.commits.get(c, again.commits[kept[0]]).ts < timedelta(hours=36)]
    assert not set(young) & set(gone)
    days = [s.commits[c].ts.date() for c in again.commits if c in was and now - again.commits[c].ts >= timedelta(hours=36)]
    assert len(days) <= 2 + len(set(days))  # of each old day the last, the root and the tag
    with pytest.raises(RevisionError):
        again.compact("side^")
    again.delete_ref("tag", "mark")
    again.compact("side^")
    assert docs(again.snapshot()) == was[kept[-2]] and docs(again.snapshot("side")) == was[kept[-1]]


def test_leases(spark, store):
    first = store.lease("job", "ann", 60)
    with pytest.raises(ConflictError):
        store.lease("job", "bob", 60)
    store.commit(ops(spark, ("l", "write", "{}")), lease=first)
    second = store.lease("job", "bob", 60, now=first.until)  # it is over by then
    assert second.fence > first.fence
    with pytest.raises(ConflictError):
        store.commit(ops(spark, ("m", "write", "{}")), lease=first)
    store.release(second)
    assert store.lease("job", "ann", 60).fence > second.fence


def test_writers_of_two_sessions(spark, engine):
    other = Engine(spark, engine.path)
    assert rows(other, "SELECT name FROM t ORDER BY k") == [("Ann",), ("Bob",)]  # the schema came with the data
    with pytest.raises(ConstraintError):
        other.sql("INSERT INTO t (k) VALUES (1)")
    engine.sql("CREATE VIRTUAL VIEW v AS SELECT name FROM t WHERE k = 1")
    engine.sql("CREATE INDEX words ON t (name) USING FULLTEXT")
    again = Engine(spark, engine.path)
    assert rows(again, "SELECT name FROM v") == [("Ann",)] and again.collection("t").indexes == engine.collection("t").indexes and again.collection("t").schema == engine.collection("t").schema
    engine.sql("DROP VIEW v")
    assert not Engine(spark, engine.path).views
    engine.sql("BEGIN")
    engine.sql("UPDATE t SET name = 'mine' WHERE k = 1")
    other.sql("UPDATE t SET name = 'theirs' WHERE k = 1")
    with pytest.raises(ConflictError):
        engine.sql("COMMIT")
    assert rows(engine, "SELECT name FROM t ORDER BY k") == [("theirs",), ("Bob",)]


def test_transactions_over_collections(spark, engine, tmp_path):
    engine.sql("CREATE TABLE u (k BIGINT)")
    both = lambda e: (rows(e, "SELECT COUNT(*) FROM t")[0][0], rows(e, "SELECT COUNT(*) FROM u")[0][0])
    engine.sql("BEGIN")
    engine.sql("INSERT INTO t (k) VALUES (5)")
    engine.sql("INSERT INTO u (k) VALUES (5)")
    engine.sql("INSERT INTO u (k) VALUES (6)")
    assert both(engine) == (3, 2) and both(Engine(spark, engine.path)) == (2, 0)
    assert len(engine.transaction("COMMIT")) == 2
    assert both(engine) == both(Engine(spark, engine.path)) == (3, 2)
    # A transaction that stops half-way is not seen, and the next writer ends it.
    engine.sql("BEGIN")
    engine.sql("INSERT INTO t (k) VALUES (7)")
    engine.sql("INSERT INTO u (k) VALUES (7)")
    store, p = engine.collection("t").store, engine.pending["t"]
    store.commit(None, "half", staged=p.parts[0], expected=p.head, txn="../_transactions/half")
    engine.pending = None
    assert both(Engine(spark, engine.path)) == (3, 2)
    other = Engine(spark, engine.path)
    other.sql("INSERT INTO t (k) VALUES (8)")
    assert decide(store.files, str(tmp_path / "_transactions" / "half"), "committed") == "aborted"
    assert both(Engine(spark, engine.path)) == (4, 2)
    # Both collections or none, if one has moved on.
    engine.collection("t").store.refresh()
    engine.sql("BEGIN")
    engine.sql("DELETE FROM u WHERE k = 5")
    engine.sql("UPDATE t SET name = 'x' WHERE k = 8")
    other.sql("UPDATE t SET name = 'y' WHERE k = 8")
    with pytest.raises(ConflictError):
        engine.sql("COMMIT")
    assert both(engine) == both(Engine(spark, engine.path)) == (4, 2) and rows(Engine(spark, engine.path), "SELECT name FROM t WHERE k = 8") == [("y",)]


def test_no_data_on_the_driver(spark, engine):
    """put() stages what it is given; nothing is collected or cached, whatever the rows are made from."""
    made = spark.range(200).select(F.concat(F.lit('{"k":'), F.col("id") + 100, F.lit("}")).alias("body"))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert engine.put("t", made).rows == 200 and engine.sql("UPDATE t SET name = 'n' WHERE k >= 100").rows == 200
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    store = engine.collection("t").store
    assert store.snapshot().select("id").distinct().count() == 202


def test_grants(spark, engine):
    for text in ("CREATE ROLE reader", "CREATE ROLE writer", "CREATE USER ann WITH PASSWORD 'pw' ROLES (reader)", "CREATE USER bob WITH PASSWORD 'x' ROLES (writer)", "CREATE USER eve WITH PASSWORD 'e'", "GRANT read ON COLLECTION main.t TO reader", "GRANT write ON DATABASE main TO writer"):
        engine.sql(text)
    as_user = lambda name, password: Engine(spark, engine.path, user=name, password=password)
    for bad in (("ann", "no"), ("nobody", "")):
        with pytest.raises(AccessError):
            as_user(*bad)
    ann, bob, eve = as_user("ann", "pw"), as_user("bob", "x"), as_user("eve", "e")
    assert rows(ann, "SELECT COUNT(*) FROM t") == rows(bob, "SELECT COUNT(*) FROM t") == [(2,)]
    for e, text in ((ann, "DELETE FROM t"), (eve, "SELECT k FROM t"), (bob, "CREATE TABLE t (k INT)"), (bob, "GRANT admin ON DATABASE main TO writer")):
        with pytest.raises(AccessError):
            e.sql(text)
    bob.sql("UPDATE t SET name = 'b' WHERE k = 1")
    one = engine.sql("SELECT _id FROM t WHERE k = 2").first()[0]
    engine.sql("REVOKE read ON COLLECTION main.t FROM reader")
    with pytest.raises(AccessError):
        ann.sql("SELECT k FROM t")
    engine.sql(f'GRANT write ON DOCUMENT "main.t.{one}" TO reader')
    assert rows(ann, "SELECT k FROM t") == [(2,)] and ann.sql("UPDATE t SET name = 'mine' WHERE k > 0").rows == 1
    with pytest.raises(AccessError):
        ann.sql("INSERT INTO t (k) VALUES (9)")
    engine.sql("DROP USER eve")
    for bad in ("CREATE ROLE reader", "GRANT read ON COLLECTION main TO reader", "GRANT fly ON DATABASE main TO reader", "DROP ROLE nope", "CREATE USER x WITH PASSWORD 'a' ROLES (nope)"):
        with pytest.raises(SqlError):
            engine.sql(bad)
    with pytest.raises(AccessError):
        as_user("eve", "e")


def test_consistency(spark, engine):
    kinds = {c: Engine(spark, engine.path, consistency=c) for c in ("snapshot", "read_committed", "read_your_writes")}
    count = lambda: {c: rows(e, "SELECT COUNT(*) FROM t")[0][0] for c, e in kinds.items()}
    assert set(count().values()) == {2}
    engine.sql("INSERT INTO t (k) VALUES (3)")
    assert count() == {"snapshot": 2, "read_committed": 3, "read_your_writes": 2}
    kinds["read_your_writes"].sql("INSERT INTO t (k) VALUES (4)")
    assert count() == {"snapshot": 2, "read_committed": 4, "read_your_writes": 4}


def test_write_back(spark, engine):
    store = engine.collection("t").store
    head, one = store.head(), store.snapshot().where("body LIKE '%Ann%'").first()["id"]
    new = ops(spark, (one, "write", '{"k":1,"name":"back"}'))
    assert engine.submit("t", new, head) == ("applied", store.head())
    assert engine.submit("t", new, head)[0] == "conflict" and engine.submit("t", ops(spark, (one, "write", '{"name":"x"}')), store.head())[0] == "rejected"


def test_pages_at_a_revision(spark, engine):
    at = engine.collection("t").store.head()
    engine.sql("DELETE FROM t WHERE k = 1")
    page, more = engine.page(f"SELECT k FROM t AT COMMIT '{at}'", 1)
    page2, end = engine.page(f"SELECT k FROM t AT COMMIT '{at}'", 1, more.first()["after"])
    assert sorted(r[0] for r in page.collect() + page2.collect()) == [1, 2] and end.count() == 0


def test_frames_and_overflow(spark, store, tmp_path):
    cut = feed.frames(store.operations().withColumn("body", F.coalesce("body", F.lit(""))), 8).collect()
    assert {(r["seq"], r["id"], r["frame"]) for r in cut} == {(1, "a", 0), (1, "b", 0), (2, "a", 0), (2, "c", 1), (3, "b", 0)}
    seen = []
    sinks = {n: (F.get_json_object("body", "$.n").cast("int") > 5, lambda df, n: seen.append(sorted((r["seq"], r["op"]) for r in df.collect()))) for n in ("one", "two")}
    q = feed.fan_out(feed.change_feed(spark, store.path), sinks, str(tmp_path / "cp"), {"processingTime": "200 milliseconds"})
    q.processAllAvailable()
    store.commit(ops(spark, ("z", "write", '{"n":6}')))
    q.processAllAvailable()
    assert q.isActive and seen[0] == seen[1] and seen[-1] == [(4, "write")] and len(seen) == 4
    q.stop()
    with pytest.raises(Exception, match="more than 2 operations"):
        feed.fan_out(feed.change_feed(spark, store.path), sinks, str(tmp_path / "cp2"), most=2).awaitTermination()
