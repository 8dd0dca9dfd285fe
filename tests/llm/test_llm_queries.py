"""The opN queries against DuckDB, and the pipeline against its stages taken by force."""

import math

import duckdb
import pytest

import corpus_pipeline
from docloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    found = con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run_whole(name, spark, sf):
    rows = spark.read.parquet(f"{sf}/{'pages' if 'op8' in name else 'documents'}.parquet").count()
    n = QUERIES[name](spark, sf).count()
    assert n == rows or name.startswith("op10_") and 0 < n


def test_pipeline(spark, sf, tmp_path):
    from test_free import LIBRARY, classes_by_force, edits_in, languages_by_force, normal
    from test_native import boilerplate, counts

    from docloom.llm import decontaminate, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in docs.where("length(text) > 400").orderBy("doc_id").limit(16).collect()]
    line = "The same line of a site, Over  and over, in all its pages and then some more of it"
    own = [(9000 + i, f"{line}\n{t[100 : 130 if i % 4 == 0 else 400]} {i} {i + 1} the and of to in\n{line.upper()}", "en", "src0", 0) for i, t in enumerate(texts)]
    docs.unionByName(spark.createDataFrame(own, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    whole = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    told = languages_by_force(spark, docs)
    rest = [x for x in whole if not told[x[0]][2]]
    lines = boilerplate([(t, h) for _, t, h, _ in rest], 10)
    rows = []
    for d, t, h, _ in rest:
        n, _, _, _, repeats = counts(t)
        cleaned, lost = lines[t, h]
        if n >= 20 and 100 * repeats <= 30 * n and lost <= 0.7 * n:
            rows.append((d, cleaned))
    assert len({lost for _, lost in lines.values()}) > 1 and len(rest) - len(rows) > 3
    least = classes_by_force(rows)
    rows = [(d, t) for d, t in rows if least[d] == d]
    items = decontaminate.Items.of([tuple(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()])
    clean = {}
    for d, t in rows:
        n = normal(t)
        patterns = ["".join(map(chr, p)) for p in items.text]
        # A shared fifth of the item is certain where it is met within its edits, so others need not be aligned.
        near = [k for k, p in enumerate(patterns) if any(p[i : i + len(p) // 12] in n for i in range(0, len(p) - len(p) // 12, max(1, len(p) // 12)))]
        if not any(edits_in(patterns[k], n) <= items.edits[k] for k in near):
            clean[d] = LIBRARY.encode_ordinary(t)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {d: r["ids"] for d, r in got.items()} == clean and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_stages_take_awkward_tables(spark, sf):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score int, text_hash string, c0 int, leaks string"
    long = " ".join(f"word{i % 997}x{i}" for i in range(5000))
    rows = [(1, None, None, None, None, 1, "a", 1, None), (None, long, "en", None, 5, None, None, None, None), (2, long, "en", "s", 5, 1, "b", 2, "x"), (2, long, "en", "s", 5, 1, "b", 2, "x"), (3, "", "en", "s", 0, 1, "c", 3, "y")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kinds)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, kinds), sf).where("text = ''").count() == 1
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, kinds), sf).where("length(text) > 9").count() == 1
