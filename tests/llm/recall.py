"""Recall of near duplicates and of decontamination by the rate of planted edits: python tests/llm/recall.py prints two tables."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def edited_words(words, rate, rng):
    return [rng.choice(words) + "x" if rng.random() < rate else w for w in words]


def edited_characters(text, n, rng):
    out = list(text)
    for k in rng.sample(range(len(out)), n):
        out[k] = rng.choice(["", "q", out[k] + "z"])
    return "".join(out)


def main():
    from collections import Counter

    from pyspark.sql import SparkSession

    from docloom.llm import decontaminate, minhash

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rng = random.Random(12)
    sf = "/root/testdata/sf0.01"
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 600 and 6000").orderBy("doc_id").limit(250).collect()]

    def overlap(a, b):
        x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
        shared = sum((x & y).values())
        return shared / (sum(x.values()) + sum(y.values()) - shared)

    print("near duplicates: words edited, pairs, similarity >= 0.8, of these caught, of all caught")
    for rate in (0.005, 0.01, 0.02, 0.03, 0.05):
        rows, similar = [], {}
        for i, t in enumerate(texts):
            copy = edited_words(t.split(), rate, rng)
            rows += [(2 * i, f"{i} {i}x " + t), (2 * i + 1, f"{i} {i}x " + " ".join(copy))]
            similar[i] = overlap([f"{i}", f"{i}x", *t.split()], [f"{i}", f"{i}x", *copy])
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        near = [i for i in similar if similar[i] >= 0.8]
        hit = {i for i in similar if got[2 * i] == got[2 * i + 1]}
        print(f"{rate:.1%}, {len(texts)}, {len(near)}, {sum(i in hit for i in near) / max(len(near), 1):.3f}, {len(hit) / len(texts):.3f}")

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    print("decontamination: characters edited, passages, caught")
    for rate in (0.0, 0.02, 0.04, 0.06, 0.08, 0.1):
        rows = []
        for n in range(5):
            for i, t in items:
                host = rng.choice(texts)
                rows.append((1000 * n + i, host[:200] + " " + edited_characters(t, int(len(t) * rate), rng) + " " + host[200:400]))
        found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
        print(f"{rate:.0%}, {len(rows)}, {sum(any(x['item_id'] == r['doc_id'] % 1000 for x in r['leaks']) for r in found) / len(rows):.3f}")


if __name__ == "__main__":
    main()
