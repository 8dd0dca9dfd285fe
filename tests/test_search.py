import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.functions.text_analysis import stem, tokens, tokens_of
from docloom.operators import search
from docloom.session import Engine


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("deployments", "deploy"), ("databases", "databas"), ("is", "is")])
def test_stems(word, want):
    assert stem(word) == want


def test_analysis(spark):
    text = "The Databases, über-cool: don't stop 42 " + "x" * 65
    want = ["databas", "über", "cool", "don", "t", "stop", "42"]
    assert tokens_of(text) == want
    assert spark.createDataFrame([(text,)], "x string").select(tokens(F.col("x"))).first()[0] == want


CORPUS = [("1", "Deploy databases", "how to deploy a database fast", ["ops", "db"]), ("2", "Cooking", "bread and butter", ["food"]), ("3", "Fast food", "a database of bread", ["food", "db"]), ("4", "", "", [])]


def test_bm25_by_hand(spark):
    df = spark.createDataFrame(CORPUS, "id string, title string, body string, tags array<string>")
    fields = {"title": 3.0, "body": 1.0, "tags": 2.0}
    hits = {r["id"]: r["score"] for r in search.bm25(search.analyzed(df, "id", fields), fields, "database").collect()}
    t = [{"title": tokens_of(a), "body": tokens_of(b), "tags": [x for y in c for x in tokens_of(y)]} for _, a, b, c in CORPUS]
    n = sum(any(d.values()) for d in t)
    df_t = sum(any("databas" in v for v in d.values()) for d in t)
    want = {}
    for (i, *_), d in zip(CORPUS, t):
        s = 0.0
        for f, w in fields.items():
            tf, mean = d[f].count("databas"), sum(len(x[f]) for x in t) / n
            s += w * math.log(1 + (n - df_t + 0.5) / (df_t + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d[f]) / mean))
        if s:
            want[i] = s
    assert hits.keys() == want.keys() == {"1", "3"} and all(abs(hits[k] - want[k]) < 1e-5 for k in want)
    index = search.analyzed(df, "id", fields)
    found = lambda q: sorted(r["id"] for r in search.bm25(index, fields, q).collect())
    assert found('"deploy database"') == ["1"] and found('"fast database"') == [] and found("the of") == [] and found("bread deploy") == ["1", "2", "3"]
    assert found('"ops db"') == []  # elements of an array are apart


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 0.0]), ("d", [1.0, 0.0]), ("e", None)], "id string, v array<double>")
    top = lambda m, k=None: [(r["id"], round(r["score"], 4)) for r in search.best(search.vector_search(df, "id", "v", [1.0, 1.0], m), k or 9).collect()]
    assert top("cosine") == [("a", 0.7071), ("b", 0.7071), ("d", 0.7071), ("c", 0.0)]
    assert top("ip", 2) == [("b", 2.0), ("a", 1.0)] and top("l2", 1) == [("a", 0.5)]
    with pytest.raises(PySparkException):
        search.vector_search(df, "id", "v", [1.0]).collect()


@pytest.mark.parametrize("metric", search.METRICS)
def test_many_searches_at_once(spark, sf, metric, monkeypatch):
    """The same hits and scores as one search after another, ties by id too, in blocks of queries and with a vector of which there are many copies."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.array_repeat(F.lit(0.5).cast("float"), 64)).when(F.col("vec_id") == 3, F.array_repeat(F.lit(0.0).cast("float"), 64)).otherwise(F.col("embedding")).alias("embedding"))
    at = df.where("vec_id IN (0, 3, 50, 100)").orderBy("vec_id").collect()
    asked = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in at], "query long, v array<float>")
    monkeypatch.setattr(search, "QUERIES", 3)
    monkeypatch.setattr(search, "TILE", 40)
    index = search.build_cells(df, "vec_id", "embedding", cells=4)
    for many, one in ((search.search_many(df, "vec_id", "embedding", asked, metric, 5), lambda v: search.vector_search(df, "vec_id", "embedding", v, metric, 5)), (search.cell_search_many(index, asked, metric, 5, probes=2), lambda v: search.cell_search(index, v, metric, 5, probes=2))):
        found = {(r["query"], r["id"], r["score"]) for r in many.collect()}
        assert found == {(r["vec_id"], h["id"], h["score"]) for r in at for h in one(list(r["embedding"])).collect()} and len(found) == 20
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many", "many")
    search.search_many(df, "vec_id", "embedding", df.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), metric, 5).count()
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(jobs.getJobIdsForGroup("many")) < 20


def test_fusion(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 2.0)], "id string, score float")
    b = spark.createDataFrame([("y", 5.0), ("w", 5.0)], "id string, score float")
    got = {r["id"]: r["score"] for r in search.fuse([search.Arm(a), search.Arm(b)], "rrf").collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in {"x": 1 / 61, "y": 1 / 62 + 1 / 62, "z": 1 / 63, "w": 1 / 61}.items())
    got = {r["id"]: round(r["score"], 4) for r in search.fuse([search.Arm(a), search.Arm(b, 0.5)], "weighted").collect()}
    assert got == {"x": 1.0, "y": 0.5, "z": 0.0, "w": 0.5}
    assert [r["id"] for r in search.fuse([search.Arm(a, depth=1), search.Arm(b, min_score=6.0)], "rrf", 5).collect()] == ["x"]


def test_search_in_sql(spark):
    e = Engine(spark)
    rows = [(i, '{"title": "%s", "body": "%s"}' % (a, b), [float(len(a)), 1.0]) for i, a, b, _ in CORPUS]
    e.register("d", spark.createDataFrame(rows, "_id string, _doc string, vec array<double>"), "_id", "_doc")
    e.sql("CREATE INDEX ft ON d (title WEIGHT 3, body) USING FULLTEXT")
    assert [r[0] for r in e.sql("SELECT _id FROM d WHERE MATCH(ft, 'database') ORDER BY MATCH(ft, 'database') DESC").collect()] == ["1", "3"]
    assert [r[0] for r in e.sql("SELECT MATCH(body, 'bread') > 0 AS hit FROM d ORDER BY _id").collect()] == [False, True, True, False]
    assert [r[0] for r in e.sql("SELECT _id FROM d ORDER BY FUSE(MATCH(ft, 'fast'), SIMILARITY(vec, [9, 1])) DESC LIMIT 1").collect()] == ["3"]
    assert [r["id"] for r in e.search("d", text=("ft", "fast"), limit=2).collect()] == ["3", "1"]
    both = e.search("d", text=("ft", "fast"), vector=("vec", [9.0, 1.0]), mode="weighted", include=True)
    assert both.columns == ["id", "score", "document"] and both.count() == 4


def test_one_definition_of_tokens(spark):
    for text in ("x² a_b İstanbul ½ n°5 étudé Ⅷ", "snake_case, kebab-case; e-mail@host.org"):
        assert spark.createDataFrame([(text,)], "x string").select(tokens(F.col("x"))).first()[0] == tokens_of(text)


def test_stored_full_text(spark, tmp_path):
    """The stored index gives what a scan gives: fields with weights, phrases, arrays, and documents that changed since it was built."""
    e, plain = Engine(spark, str(tmp_path)), Engine(spark)
    for i, title, body, tags in CORPUS:
        e.put("d", spark.createDataFrame([(json.dumps({"id": i, "title": title, "body": body, "tags": tags}),)], "body string"))
    e.sql("CREATE INDEX ft ON d (title WEIGHT 3, body, tags WEIGHT 2) USING FULLTEXT")
    queries = ["database", "bread deploy", '"deploy database"', '"fast database"', '"ops db"', "the of", "fast food", '"bread butter" database', "nothing"]

    def same():
        plain.register("d", e.documents(e.collection("d")), "_id", "_doc")
        if not plain.collections["d"].indexes:
            plain.sql("CREATE INDEX ft ON d (title WEIGHT 3, body, tags WEIGHT 2) USING FULLTEXT")
        for q in queries:
            read = f"SELECT _id, MATCH(ft, '{q}') AS s FROM d WHERE MATCH(ft, '{q}') ORDER BY s DESC, _id"
            got, want = ([(r[0], round(r[1], 4)) for r in x.sql(read).collect()] for x in (e, plain))
            assert got == want, q

    assert e.collection("d").store.tables["ft"]["documents"] == 3
    same()
    e.put("d", spark.createDataFrame([('{"id": "5", "title": "Fast databases", "body": "deploy bread"}',), ('{"id": "1", "title": "Gone", "body": "bread"}',)], "body string"))
    e.sql("DELETE FROM d WHERE title = 'Cooking'")
    same()
    e.reindex("d")
    assert Engine(spark, str(tmp_path)).collection("d").store.tables == e.collection("d").store.tables
    same()


def test_key_indexes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    docs = [{"id": f"{i:03}", "n": i if i % 5 else str(i), "tags": [f"t{i % 7}", i % 3], "f": i + 0.5} for i in range(60)]
    put = lambda rows: e.put("d", spark.createDataFrame([(json.dumps(x),) for x in rows], "body string"))
    put(docs)
    wheres = ["n = 7", "n = '10'", "n > 50", "n BETWEEN 10 AND 12", "n IN (1, 2, '5')", "tags = 't3'", "tags = 2 AND n < 9", "f >= 58.5", "n = 7 OR n = 8", "tags <> 't1' AND n <= 3", "n = NULL", "n = TRUE"]
    read = lambda: [sorted(r[0] for r in e.sql(f"SELECT _id FROM d WHERE {w}").collect()) for w in wheres]
    want = read()
    e.sql("CREATE INDEX by_n ON d (n) USING BTREE")
    e.sql("CREATE INDEX by_tag ON d (tags) USING HASH")
    e.sql("CREATE INDEX by_f ON d (f) USING BTREE")
    assert read() == want
    files = lambda w: e.sql(f"SELECT _id FROM d WHERE {w}").inputFiles()
    assert all("/indexes/" in f for f in files("n = 7")) and all("/ops/" in f for f in files("n = 7 OR n = 8"))
    put([{"id": "007", "n": 70}, {"id": "100", "n": 7, "tags": "t3"}])
    e.sql("DELETE FROM d WHERE n = '10'")
    behind = read()
    e.reindex("d")
    assert read() == behind and len(behind[0]) == 1 and behind[0][0] in behind[5] and behind[1] == []


def test_no_index_for_instants(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.sql("CREATE TABLE d (n BIGINT, at TIMESTAMP)")
    e.put("d", spark.createDataFrame([('{"n": 1, "at": "2024-01-01T00:00:00Z"}',), ('{"n": 2, "at": "2024-01-01 09:00:00"}',)], "body string"))
    read = lambda: sorted(r[0] for r in e.sql("SELECT n FROM d WHERE at < '2024-01-01 08:00:00'").collect())
    assert read() == [1]
    e.sql("CREATE INDEX by_at ON d (at) USING BTREE")
    assert read() == [1]
