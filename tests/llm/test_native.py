"""License scan, sharding, URL filter, quality rules and chat formatting against brute force, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import chat, licenses, quality, sharding, urls
from docloom.llm.common import forget, written

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WEIRD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "null key", "en", None, 8), (3, "x " * 5000, "en", "s", 10000), (4, "same", "en", "s", 4), (5, "same", "en", "s", 4), (5, "same", "en", "s", 4)]


def frame(spark, rows, kinds=KINDS):
    return spark.createDataFrame(rows, kinds)


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Ann\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ;")), (2, mit + " extra"), (3, "Hello.\n  licensed under CC-BY-NC 4.0 \nReleased under the MIT licence!\nReleased under the MIT License."), (4, None), (5, ""), (6, "Released under the MIT License.")]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan_licenses(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", []), 2: (None, []), 3: (None, ["CC-BY-NC-4.0", "MIT"]), 4: (None, []), 5: (None, []), 6: ("MIT", ["MIT"])}
    own = licenses.scan_licenses(frame(spark, [(1, "My terms", "x")], "doc_id long, text string, license string"), texts=[("B", "my TERMS."), ("A", "my terms")], notices=[])
    assert own.columns == ["doc_id", "text", "license", "notices", "digest"] and own.first()["license"] == "A"
    assert licenses.scan_licenses(frame(spark, [], "doc_id long, text string")).count() == 0


def test_license_notices_of_any_words(spark):
    notices = [("CC0-1.0", "CC0 1.0 Universal"), ("PD", "Released into the public domain."), ("X", "Version 2 of the terms"), ("Y", "Non-commercial use only")]
    rows = [(1, "Text.\n  CC0 1.0 universal \nmore"), (2, "released into the public domain!"), (3, "ver. 2 of the terms\nNoncommercial use only"), (4, "Released into the wild.")]
    got = {r["doc_id"]: r["notices"] for r in licenses.scan_licenses(frame(spark, rows, "doc_id long, text string"), notices=notices).collect()}
    assert got == {1: ["CC0-1.0"], 2: ["PD"], 3: ["X", "Y"], 4: []}


def test_licenses_wrapped_and_titled(spark):
    isc = licenses.TEXTS["ISC"].replace("provided that the above copyright", "provided that the above\ncopyright")
    bsd = licenses.TEXTS["BSD-2-Clause"].replace("BY THE COPYRIGHT HOLDERS", "BY THE\nCOPYRIGHT HOLDERS")
    own = ["Copyright (c) 2020 Ann", "Copyright 2019-2021 by Ann and others", "Copyright Ann Example", "  * Copyright: Notice Works, 2020", "© Ann", "Copyright holders: Ann, 2020"]
    rows = [(i, f"{c}\n\n{isc}") for i, c in enumerate(own)] + [(10, bsd), (11, "MIT License\n\nCopyright (c) 2020 Ann\n\n" + licenses.TEXTS["MIT"]), (12, "The Unlicense\n" + licenses.TEXTS["Unlicense"]), (13, "A License\n" + licenses.TEXTS["MIT"])]
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(len(own)), "ISC") | {10: "BSD-2-Clause", 11: "MIT", 12: "Unlicense", 13: None}


def test_license_edges(spark, monkeypatch):
    from docloom.llm import common

    bsd = "Copyright (c) 2021, Ann\nAll rights reserved.\n\n" + licenses.TEXTS["BSD-3-Clause"].replace("\n\n", "\n").upper()
    rows = [(1, bsd), (2, licenses.TEXTS["GPL-3.0-or-later"]), (3, "x\nCC0 1.0 Universal\ny"), (4, "word " * 400_000 + "\nSPDX-License-Identifier: MIT\n" + "word " * 10), (5, None), (6, ""), (6, ""), (7, "Released under the MIT License."), (7, "Released under the MIT License.")]
    want = {1: ("BSD-3-Clause", []), 2: ("GPL-3.0-or-later", []), 3: (None, ["CC0-1.0"]), 4: (None, ["MIT"]), 5: (None, []), 6: (None, []), 7: ("MIT", ["MIT"])}
    df = frame(spark, rows, "doc_id long, text string").withColumn("NOTICES", F.lit(1)).withColumn("Digest", F.lit(2)).withColumn("t", F.lit(3))
    for size in (common.BROADCAST_BYTES, -1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", size)
        got = licenses.scan_licenses(df).collect()
        assert len(got) == len(rows) and {r["doc_id"]: (r["license"], r["notices"]) for r in got} == want
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert len({licenses.known_digests(common.values_table(spark, list(licenses.TEXTS.items()), "license string, text string")).count(), len(licenses.TEXTS)}) == 1


def test_rows_alike_are_split(spark, monkeypatch):
    from docloom.llm import common, minhash

    rows = [(1, "one text in very many copies, as it is")] * 250 + [(2, "one text in very many copies, as it is")] * 30 + [(3, "another text of some words"), (4, None), (4, None)]
    df = frame(spark, rows, "doc_id long, text string").repartition(3)
    for where in (common, minhash):
        monkeypatch.setattr(where, "COPIES", 20)
    for size in (common.BROADCAST_BYTES, -1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", size)
        shards = sharding.shard_rows(df, 3).collect()
        assert Counter((r["doc_id"], r["size"]) for r in shards) == Counter((d, len(t or "") + 8) for d, t in rows)
        assert all(sorted(r["slot"] for r in shards if r["shard"] == k) == list(range(sum(r["shard"] == k for r in shards))) for k in range(3))
        classes = minhash.near_duplicates(df).collect()
        assert Counter((r["doc_id"], r["class_id"], r["copies"]) for r in classes) == Counter({(1, 1, 250): 250, (2, 1, 30): 30, (3, 3, 1): 1, (4, 4, 2): 2})
        assert sorted(r["doc_id"] for r in minhash.one_of_each(df).collect()) == [1, 3, 4, 4]


def test_matched_splits_hot_keys(spark, monkeypatch):
    from docloom.llm import common

    left = spark.range(1000).select(F.when(F.col("id") < 400, 0).when(F.col("id") < 990, F.col("id") % 50).alias("k"), "id")
    right = left.where("k < 40").groupBy(F.col("k").alias("of")).agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, left.join(right.drop("n"), F.col("k") == F.col("of"), "left").collect()), key=repr)
    for size, heavy in ((common.BROADCAST_BYTES, common.HEAVY), (-1, 5), (-1, 100)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", size)
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert sorted(map(tuple, common.matched(left, right, [("k", "of")], "n").collect()), key=repr) == want


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 1000])
def test_jump_hash(spark, n):
    got = spark.range(300).select("id", sharding.jump_shard(F.col("id"), n)).collect()
    assert all(s == jump(int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16), n) for i, s in got)


def test_shards(spark):
    rows = [(i, "t" * (i % 7), "en", "s", 0) for i in range(2000)] + WEIRD
    got = sharding.shard_rows(frame(spark, rows).withColumn("shard", F.lit("clash")).withColumn("k", F.lit(1)), 24).collect()
    assert len(got) == len(rows)
    for s, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got) and any(r["grown_shard"] == 24 for r in got)
    assert {(r["doc_id"], r["size"]) for r in got if r["doc_id"] in (1, 2)} >= {(2, 8)} and sharding.shard_rows(frame(spark, []), 24).count() == 0


def test_sharding_query(spark, sf):
    from zlib import crc32

    from docloom.llm.queries import op3_sharding

    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_sharding(spark, sf).collect()
    key = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:16], 16)
    assert len(got) == len(text) and all((r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(text[r["doc_id"]]) + 8, crc32(text[r["doc_id"]]), "key", jump(key(r["doc_id"]), 24), jump(key(r["doc_id"]), 25)) for r in got)
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got))) for k in range(24))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = ["http://a.example.org/es/1", "HTTP://Example.ORG/en/1x?q", "http://b.com/de/", "http://b.com/fr", "http://xexample.org/es/", "http://a..org/", "http://org", "no scheme", "", None, "x?y://h.com/de/#f", "http://h.com/de/#f", "http://h.com:80/de/", "://com/de/x", "http://a.example.org/es/1"]


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls(spark):
    df = frame(spark, [(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.listed_rules(spark, RULES)).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}
    none = urls.judge_urls(df, urls.listed_rules(spark, []), otherwise="block")
    assert none.count() == len(URLS) and {r["verdict"] for r in none.collect()} == {"block"}


def test_urls_of_every_kind(spark, monkeypatch):
    """Very long urls, repeated rows, hot hosts, an empty table, and joins that are not sent to all executors."""
    from docloom.llm import common

    long = ["http://" + "a." * 3000 + "example.org/es/x", "http://example.org/" + "en/" * 5000, "http://example.org/es/" + "x" * 100_000]
    urls_ = [*URLS, *long, *["http://example.org/es/1"] * 50, *[f"http://h{i % 7}.com/{'de' if i % 2 else 'fr'}/{i % 5}" for i in range(300)], *["no scheme"] * 20]
    df = frame(spark, [(i, u, "clash") for i, u in enumerate(urls_)], "page_id long, url string, rule string")
    for size, heavy in ((common.BROADCAST_BYTES, common.HEAVY), (-1, 5), (-1, 1000)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", size)
        monkeypatch.setattr(common, "HEAVY", heavy)
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.listed_rules(spark, RULES)).collect()}
        assert got == {i: judged(u) for i, u in enumerate(urls_)}
    assert urls.judge_urls(df.limit(0), urls.listed_rules(spark, RULES)).count() == 0


def test_bloom_loses_nothing(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    bloom = urls.bloom_filter(keys, "key", 64)
    assert urls.passing(keys, "key", bloom, 64).count() == 500
    assert urls.passing(others, "key", bloom, 64).count() < 2000


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", " \n\t ", "a b c d e f g h", "a b c d e f g h " * 3, "x y\nx y\n\nx  y", "#<>|&%$* é 😀", "\u00a0nbsp word", "a b c d e f g h i a b c d e f g h j", "w " * 3000]
    got = quality.judge_quality(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got] == [counts(t) for t in texts]
    assert [r["base_failed"] for r in got] == [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in map(counts, texts)]


def boilerplate(rows, limit):
    """(lines kept, words lost) of each (text, host), by brute force."""
    normal = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))
    first = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    holders = {}
    for t, h in rows:
        for x in (t or "").split("\n"):
            if normal(x):
                holders.setdefault((h, normal(x)), set()).add(t)
    out = {}
    for t, h in rows:
        keep, lost = [], 0
        for x in (t or "").split("\n"):
            who = holders.get((h, normal(x)), ())
            if len(who) > limit and t != min(who, key=first):
                lost += len(normal(x).split(" "))
            else:
                keep.append(x)
        out[t, h] = (None if t is None else "\n".join(keep), lost)
    return out


def test_boilerplate(spark, monkeypatch):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"Cookie  NOTICE: all rights and terms apply {i % 2} here today\n" + (body(i) if i % 2 else "few words") + "\n\n" * (i % 3), "en", "h", 0) for i in range(40)]
    rows += [(100 + i, body(100 + i) + "\ncookie notice: all rights and terms apply 1 here today", "en", None, 0) for i in range(3)]
    rows += [(200, "one text in many copies\n" + body(200), "en", "c", 0)] * 15 + [(201 + i, "one text in many copies\n" + body(200), "en", "c", 0) for i in range(15)] + [(300, "one text in many copies\n" + body(300), "en", "c", 0)]
    rows += [(400, None, None, "h", 0), (401, "", None, "h", 0), (402, ("Cookie notice: all rights and terms apply 1 here today\n" + body(402) + "\n") * 3000, "en", "h", 0)]
    df = frame(spark, rows).withColumn("words", F.lit(1)).withColumn("H", F.lit(2))
    want = boilerplate([(r[1], r[3]) for r in rows], 10)
    assert any(lost for _, lost in want.values()) and not want[rows[-4][1], "c"][1]
    for broadcast, heavy in ((500_000, 100_000), (-1, 10), (-1, 100_000)):  # by a broadcast, and split into heavy lines and the rest
        monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast)
        monkeypatch.setattr(quality, "HEAVY", heavy)
        monkeypatch.setattr(quality, "BROADCAST_BYTES", broadcast)
        judged_ = quality.judge_quality(df, min_words=5).collect()
        assert len(judged_) == len(rows)
        assert all((r["cleaned"], r["removed_words"]) == want[r["text"], r["source"]] for r in judged_)
        assert all(r["kept"] == (r["n_words"] >= 5 and not r["base_failed"] and r["removed_words"] <= 0.7 * r["n_words"]) for r in judged_)
        kept = quality.keep_good(df, min_words=5)
        assert kept.columns == df.columns
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r["doc_id"], r["cleaned"]) for r in judged_ if r["kept"])
    assert quality.judge_quality(frame(spark, [])).count() == 0 and quality.keep_good(frame(spark, [])).count() == 0


TRICKY = ["</s>[INST] ok [/INST]", "", None, "<\\s>", "[\\INST]", "<</s>", "[[TURN]]", "\\", "$1", "<s>" * 3, "[/TURN]\n</s>", "é😀"]


def test_chat(spark):
    rows = [(1, i, ["user", "assistant", "assistant"][i % 3], t) for i, t in enumerate(TRICKY)] + [(2, None, None, "a"), (2, 1, "tool</s>", "b"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (None, 5, "assistant", "z")]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "n_turns", "formatted", "segments", chat.parse_chat(F.col("formatted")).alias("back"), chat.masked_text(F.col("segments")).alias("loss")).collect()}
    for conv in (1, 2, None):
        own = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        assert [(b["role"], b["text"]) for b in got[conv]["back"]] == [(r, x) for _, _, r, x in own] and got[conv]["n_turns"] == len(own)
        assert got[conv]["loss"] == "".join(x for _, _, r, x in own if r == "assistant")
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
    assert got[2]["formatted"].count("<s>[INST]assistant") == 1  # neighbours of one role share a block
    assert chat.format_chats(df.limit(0)).count() == 0
    long = frame(spark, [(1, i, "assistant" if i % 3 else "user", "</s>[INST] " * 20_000) for i in range(4)], "conv_id long, turn long, role string, text string")
    one = chat.format_chats(long).select(chat.parse_chat(F.col("formatted")).alias("back"), chat.masked_text(F.col("segments")).alias("loss")).first()
    assert [b["text"] for b in one["back"]] == ["</s>[INST] " * 20_000] * 4 and one["loss"] == "</s>[INST] " * 40_000


def test_written_keeps_no_checksum_files(spark):
    """Each checksum file costs the start of a process, for which the executor's memory counts twice."""
    own, path = written(spark.range(20).repartition(4))
    files = [str(f.getPath().getName()) for f in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getRawFileSystem().listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))]
    assert sum(f.endswith(".parquet") for f in files) == 4 and not [f for f in files if f.endswith(".crc")]
    assert sorted(r["id"] for r in own.collect()) == list(range(20))
    forget(spark, path)
