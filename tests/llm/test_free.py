"""BPE, language ID, HTML text, near duplicates and decontamination against the library, brute force or held-out data, and their edge cases."""

import base64
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, html_text, langid, minhash

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = bpe.Vocabulary(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def encoded(text):
    data = text.encode()
    return VOCABULARY.encode(data, np.array([len(data)]))[0].tolist() if data else []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("'strevmld \n\t\u00a0\u0085\x1c1!²½中😀ſİ\u0300_")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_bpe_is_the_librarys(text):
    assert encoded(text) == LIBRARY.encode_ordinary(text)
    assert VOCABULARY.decode(np.array(encoded(text), np.int64)) == text.encode()


def test_bpe_long_slices():
    for text in ("a" * 5000, " " * 3000 + "x", "ab'" * 900, "é" * 999, "word " * 4000):
        assert encoded(text) == LIBRARY.encode_ordinary(text)


def test_code_point_classes():
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for p, kinds in ((r"\p{L}", range(bpe.LETTER + 1)), (r"\p{N}", [bpe.NUMBER]), (r"\s", [bpe.SPACE, bpe.WHITE])):
        e = tiktoken.Encoding("x", pat_str=p, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        text = "".join(map(chr, every))
        found = "".join(e.decode_bytes(e.encode_ordinary(text[k : k + 50_000])).decode() for k in range(0, len(text), 50_000))
        assert [ord(c) for c in found] == [c for c in every if bpe.code_point_classes()[c] in kinds]


def test_bpe_frames(spark):
    texts = [None, "", "Hello world's end", "x" * 100_000, "same", "same", "é 中"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("IDS", F.lit(1))
    rows = bpe.decode_ids(bpe.encode_texts(df, PATH), PATH).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r["ids"] == LIBRARY.encode_ordinary(t or "") and r["decoded"] == (t or "").encode()
        assert [r["decoded"][a:b] for a, b in zip(r["offsets"], [*r["offsets"][1:], len(r["decoded"])])] == [VOCABULARY.words[i] for i in r["ids"]]
    both = bpe.encode_texts(df, PATH, offsets=None, decoded="out").orderBy("doc_id").collect()
    assert [(r["ids"], r["out"]) for r in both] == [(r["ids"], r["decoded"]) for r in rows]
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0


def test_vocabularies_of_one_name(spark, tmp_path):
    """Two files of the same name in different folders are two vocabularies."""
    paths = []
    for k, pairs in enumerate(([b"ab"], [b"bc"])):
        (tmp_path / str(k)).mkdir()
        paths.append(str(tmp_path / str(k) / "v.tiktoken"))
        with open(paths[-1], "wb") as f:
            f.write(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate([bytes([i]) for i in range(256)] + pairs)))
    df = spark.createDataFrame([("abc",)], "text string")
    assert [list(bpe.encode_texts(df, p).first()["ids"]) for p in (*paths, paths[0])] == [[256, 99], [97, 256], [256, 99]]


def test_bpe_query(spark, sf):
    """op2 against the library, digest by digest."""
    from hashlib import sha256

    from docloom.llm.queries import op2_byte_bpe

    got = {r["doc_id"]: r for r in op2_byte_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        own = got.pop(r["doc_id"])
        assert (own["n_tokens"], own["ids_sha256"], own["decoded_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((r["text"] or "").encode()).hexdigest())
    assert not got


def test_leaks_query(spark, sf):
    """op10 against the least edit distance of every item in every document of a tenth that holds some, and of others."""
    from docloom.llm.queries import op10_decontamination

    found = {}
    for r in op10_decontamination(spark, sf).collect():
        key = (r["doc_id"], r["item_id"])
        found[key] = min(found.get(key, 99), r["edits"])
    items = decontaminate.Items.of([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()])
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r["text"] or "") < 3000]
    held = {d for d, _ in found}
    docs = [r for r in docs if r["doc_id"] in held][:12] + [r for r in docs if r["doc_id"] not in held][:12]
    for r in docs:
        n = normal(r["text"] or "")
        want = {items.ids[k]: e for k, p in enumerate(items.text) if (e := edits_in("".join(map(chr, p)), n)) <= items.edits[k]}
        assert {i: e for (d, i), e in found.items() if d == r["doc_id"]} == want


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").withColumn("score", F.lit("clash"))
    got = langid.identify(docs).withColumn("held_out", langid.held_out(F.col("doc_id"))).where("held_out AND length(text) > 80").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got) and sum(r["rejected"] for r in got) <= 0.03 * len(got)


def languages_by_force(spark, docs):
    """{doc_id: (lang_pred, score, rejected)}, subword by subword, with the model that the sample gives."""
    import unicodedata

    model = langid.train(langid.sample_labelled(docs))
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    out = {}
    for r in docs.collect():
        words = "".join(low(c) if unicodedata.category(c)[0] == "L" else " " for c in r["text"] or "").split()
        total, n = np.zeros(len(model.languages)), 0
        for w in words:
            s = [0, *map(ord, w), 0]
            for k in langid.ORDERS:
                for i in range(len(s) - k + 1):
                    h = (s[i] * 0x9E3779B1 + 17) & 0xFFFFFFFF
                    for x in s[i + 1 : i + k]:
                        h = ((h ^ x) * 0x85EBCA6B) & 0xFFFFFFFF
                        h ^= h >> 13
                    total += model.vectors[((h * 0xC2B2AE35 + k) & 0xFFFFFFFF) >> (32 - langid.BITS)]
                    n += 1
        if not n:
            out[r["doc_id"]] = ("und", 0.0, True)
            continue
        e = np.exp((total / n + model.bias) * model.sharpness)
        p = (e / e.sum()).tolist()
        out[r["doc_id"]] = (model.languages[p.index(max(p))], max(p), max(p) < model.threshold)
    return out


def test_language_id_by_force(spark, sf):
    from docloom.llm.queries import op5_language_id

    want = languages_by_force(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r["doc_id"]: r for r in op5_language_id(spark, sf).collect()}
    assert got.keys() == want.keys() and {r["lang_pred"] for r in got.values()} >= {"en", "de", "fr", "es"}
    assert all((r["lang_pred"], r["rejected"]) == (want[d][0], want[d][2]) and abs(r["score"] - want[d][1]) < 1e-5 and r["held_out"] == (__import__("zlib").crc32(str(d).encode()) % 4 == 2) for d, r in got.items())


def test_many_languages_and_wrong_labels(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(30):  # more languages than dimensions; each its own words
        words = ["".join(rng.choice(letters[k % 13 :: 2] + letters[k // 2]) for _ in range(rng.randint(3, 7))) for _ in range(40)]
        rows += [(100 * k + i, " ".join(rng.choice(words) for _ in range(60)), f"l{k}" if rng.random() > 0.05 else "l0") for i in range(12 if k else 40)]
    rows.append((9002, "zzq " * 40_000, "rare"))  # the rarest language, by one text above MAX_TRAIN_CHARS
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert {lang for lang, _ in langid.sample_labelled(df)} == {r[2] for r in rows}
    assert [len({lang for lang, _ in langid.sample_labelled(df, docs=5, in_all=31)}), len(langid.sample_labelled(df, in_all=31))] == [31, 31]
    assert sum(r["lang_pred"] == f"l{r['doc_id'] // 100}" for r in got if r["doc_id"] < 9000) > 0.9 * len(got)
    assert sum(r["rejected"] for r in got) < 0.2 * len(got)  # one label in twenty is wrong, yet most are told


def test_language_id_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ...", "en"), (4, "the cat", None), (None, "the dog and the cat", "en"), (6, "der Hund und die Katze", "de"), (6, "der Hund und die Katze", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == 7 and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got} <= {"und", "en", "de"}
    assert all(r["rejected"] == (r["doc_id"] in (1, 2, 3)) for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.identify(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><div class="menu"><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div><div id=content><h2>Head &amp; line</h2>
<p>First <b>bo</b>ld, with text; and more of it.&nbsp;Ends here.<p>Second one, unclosed &lt;tag&gt;, also long enough.</p><!-- no -->
<ul><li>item one, a longer one.</li><li>item two</li></ul></div><aside>Side bar.</aside><div class="notice-bar">We use cookies, agree.</div>
<form>Search <input name=q></form><section class="comments"><p>Nice post, I like it, really.</p></section><footer>&copy; me</footer><p"""


def test_html():
    want = "Head & line First bold, with text; and more of it. Ends here. Second one, unclosed <tag>, also long enough. item one, a longer one. item two"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text("<p>just &am text") == "just &am text"
    assert [html_text.main_text(x) for x in (None, "", "<html></html>", "<script>x")] == ["", "", "", ""]
    html_text.main_text('<a href="x>' * 2000)  # ends, whatever the markup
    article = "<p>Some text of the article, which is long enough. It goes on, and on.</p>"
    for noise in ('<div id="cookieBanner">We use, x.</div>', '<ins class="adsbygoogle">Buy, now.</ins>', '<ol class="comment-list"><li>Nice, one.</li></ol>', '<p hidden>Gone, too.</p>', '<div style="display: none">No, never.</div>', '<div role="navigation">Go, there.</div>', "<select><option>A, b.</select>"):
        assert html_text.main_text(f"<body>{noise}<div class='content has-sidebar'>{article}</div>{noise}</body>") == re.sub("<.*?>", "", article)
    assert html_text.main_text(f"<article><div class=article-header><h1>Head</h1></div>{article}</article>").startswith("Head Some text")


def test_html_articles(spark, sf):
    pages = html_text.extract(spark.read.parquet(f"{sf}/pages.parquet").withColumn("TEXT", F.lit(1))).collect()
    for r in pages:
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r["html"], re.S)[1]
        words = re.sub(r"<[^>]*(?:>|\Z)", " ", body)
        assert r["text"] == " ".join(__import__("html").unescape(words).split())


def test_html_links_in_text():
    p = "<p>See <a href=x>the report</a> for more, and <b><a href=y>its notes</a></b>; both are long. Rea<a href=z>d</a> on.</p>"
    items = "<ul class=points><li>First point, with <a href=x>a source</a> of its own.</li><li>Second point, <a href=y>another</a>.</li><li><a href=z>Third</a>, and last.</li></ul>"
    links = "<ul class=more><li><a href=1>Other page</a></li><li><a href=2>One more page</a></li></ul>"
    want = "Head See the report for more, and its notes; both are long. Read on. First point, with a source of its own. Second point, another. Third, and last."
    for body in (f"<article><h1><a href=h>Head</a></h1>{p}{items}{links}</article>", f"<div id=text><h1><a href=h>Head</a></h1>{p}{items}</div>{links}"):
        assert html_text.main_text(f"<body>{body}</body>") == want


@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_html_short_blocks_beside_long_paragraphs(outer):
    paragraph = "<p>" + "A long sentence with a mark, of a hundred characters or so, that goes on for as long as it can do. " * 10 + "</p>"
    table = lambda cell: "<table>" + "".join("<tr>" + "".join(f"<td>{cell(10 * r + c)}</td>" for c in range(10)) + "</tr>" for r in range(20)) + "</table>"
    short = table(lambda i: f"c{i:04d}") + table(lambda i: i % 10) + "<ul>" + "".join(f"<li>Item {i} of a list, sixty characters long or so, no more</li>" for i in range(30)) + "</ul>"
    short += "<figure><img src=x><figcaption>A view</figcaption></figure><blockquote>To be or not</blockquote><ol><li>1</li><li>2</li></ol>"
    links = "<ul class=more><li><a href=1>Other page</a></li><li><a href=2>One more</a></li></ul><div class=path><a href=1>Top</a> | <a href=2>Part</a> | <a href=3>Here</a></div>"
    for body in (paragraph * 10 + short + paragraph * 10, short + paragraph * 20):
        got = html_text.main_text(f"<body>{links}<{outer}>{body}{links}</{outer}></body>")
        assert got == " ".join(re.sub("<.*?>", " ", body).split())


RENAMED = {
    "given": lambda x: x,
    "no article": lambda x: re.sub(r"<(/?)article>", r"<\1div>", x),
    "no classes": lambda x: re.sub(r"<(/?)article>", r"<\1div>", x).replace(' class="ad"', ""),
    "no names": lambda x: re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", x).replace(' class="ad"', ""),
}


def test_html_ratios_decide(sf, monkeypatch):
    """Without names that tell, the ratios still find most articles; without the ratios none is found."""
    import html

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    want = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", x, re.S)[1])).split()) for x in pages]
    found = lambda name: sum(html_text.main_text(RENAMED[name](x)) == w for x, w in zip(pages, want)) / len(pages)
    assert [found("given"), found("no article")] == [1.0, 1.0] and found("no classes") > 0.85 and found("no names") > 0.55
    whole = html_text.ratios

    def alike(p):
        r = whole(p)
        one = dict.fromkeys(r.product, 1.0)
        return html_text.Ratios([(q, e, 1) for q, e, _ in r.blocks], one, one, dict.fromkeys(one, False))

    monkeypatch.setattr(html_text, "ratios", alike)
    assert found("no classes") < 0.1 and found("no names") < 0.1


def test_html_names_are_weights():
    long = "A long sentence with a mark, of a hundred characters or so, that goes on for as long as it can do. " * 5
    page = f"<body><div class=text><p>{long}</p><section class='research-form'><p>{long}</p></section><math><mi>x</mi></math><p>Wo<img src=a>rd one, and mo<wbr>re.</p><div class=share><a href=1>Share</a> this</div></div></body>"
    assert html_text.main_text(page) == " ".join(f"{long} {long} x Word one, and more.".split())
    assert html_text.main_text(f"<body><form id=aspnetForm><div class=menu>Home, and more.</div><div><p>{long}</p><p>{long}</p></div></form></body>") == " ".join((long + long).split())
    assert html_text.main_text(f"<body><div class=comments><p>{long}</p></div><div class=post><h1>Head</h1><p>Short one.</p></div></body>") == "Head Short one."


def test_html_awkward_pages(spark):
    import resource

    deep = "<div>" * 100_000 + "deep text, here." + "</div>" * 50_000
    odd = "<b><p>" * 20_000 + "x" + "</i>" * 20_000
    long = "<body><article>" + "<p>A sentence, with marks. And one more.</p>" * 230_000 + "</article></body>"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert html_text.main_text(deep) == "deep text, here." and html_text.main_text(odd) == "x"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB
    rows = [(1, long), (2, deep), (3, None), (4, ""), (5, PAGE), (5, PAGE), (5, PAGE)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("TEXT", F.lit(1)).withColumn("path", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html_text.extract(df).collect()]
    assert Counter(got) == Counter((i, html_text.main_text(x)) for i, x in rows) and dict(got)[1].count("marks.") == 230_000
    assert html_text.extract(df.limit(0)).count() == 0


# ---- near duplicates


def shingle_counts(t):
    w = t.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def classes_by_force(rows):
    """doc_id -> least doc_id of its class, all pairs compared."""
    rows = [(d, t) for d, t in rows]
    own = [shingle_counts(t) if t and t.split() else None for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = own[i], own[j]
            if a and b:
                shared = sum(min(n, b[k]) for k, n in a.items())
                if rows[i][1] == rows[j][1] or shared * 5 >= (sum(a.values()) + sum(b.values()) - shared) * 4:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(root(i), []).append(d)
    return {d: min(v) for v in best.values() for d in v}


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    texts = []
    for _ in range(8):
        base = [word() for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += ["repeat this line please now " * n for n in (1, 2, 3, 40, 41)] + ["a b", "a b", "a  b", "", None, " ", None]
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [12, 2])
def test_near_duplicates(spark, small, monkeypatch):
    for name, v in (("SMALL", small), ("OUTSIDERS", 2 if small == 2 else 128), ("MEMBERS", 3 if small == 2 else 1024)):
        monkeypatch.setattr(minhash, name, v)
    rows = near_copies(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()} == classes_by_force(rows)


def test_near_duplicates_edges(spark):
    rows = [(None, "x y z"), (None, "x y z"), (9, "x y z"), (3, None), (3, None), (4, ""), (5, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("text_hash", F.lit(2))
    got = sorted(((r["doc_id"], r["class_id"], r["copies"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 9, 2), (None, 9, 2), (9, 9, 1), (3, 3, 2), (3, 3, 2), (4, 4, 1), (5, 5, 1)], key=str)
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "4", "5", "None"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.one_of_each(df.limit(0)).count() == 0


def test_near_duplicates_of_very_long_texts(spark):
    words = [f"w{i * i % 99_991}" for i in range(150_000)]
    near = [w if i % 200 else "x" for i, w in enumerate(words)]
    far = [w if i % 15 else "x" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words)), (5, "x " * 300_000), (6, "x " * 299_000)]
    got = {r["doc_id"]: (r["class_id"], r["copies"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(7)).withColumn("K", F.lit(8))).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (1, 1), 5: (5, 1), 6: (5, 1)}


def test_signatures_are_unbiased():
    rng = random.Random(5)
    a, b = [], []
    for _ in range(200):
        x = [f"w{rng.randint(0, 99)}" for _ in range(rng.randint(5, 150))] * rng.choice([1, 1, 2, 5])
        y = list(x)
        for _ in range(rng.randint(0, 9)):
            y[rng.randrange(len(y))] = "z"
        a.append(" ".join(x).encode())
        b.append(" ".join(y).encode())
    shared, whole = minhash.overlap(a, b)
    both = [t for p in zip(a, b) for t in p]
    s = minhash.signatures(*minhash.shingles(b"".join(both), np.array([len(t) for t in both])), len(both))
    off = (s[0::2] == s[1::2]).mean(axis=1) - shared / whole
    assert abs(off.mean()) < 0.01 and off.std() < 0.05


# ---- decontamination


def normal(t):
    return re.sub(r"[\W_]+", " ", t.lower()).strip()


def edits_in(p, t):
    """Least edit distance of p to any part of t."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for ch in t:
        new = [0]
        for i, pc in enumerate(p, 1):
            new.append(min(row[i - 1] + (pc != ch), row[i] + 1, new[i - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_leaks(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("the re an ing ha th er nd on st".split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [(i, prose(rng.randint(4, 40)).capitalize() + ".") for i in range(20)] + [(90, "short"), (91, None), (None, prose(12)), (92, "")]
    docs = []
    for i in range(40):
        x = list(rng.choice(items[:20])[1])
        for _ in range(rng.randint(0, int(len(x) * 0.12))):
            k = rng.randrange(len(x))
            x[k] = rng.choice(["", "q", x[k] + "z"])
        t = prose(rng.randint(0, 60))
        docs.append((i, t[:30] + " -- " + "".join(x) + "! " + t[30:] if i % 5 else t))
    docs += [(100, None), (101, ""), (102, items[3][1] * 2), (102, items[3][1] * 2)]
    own = decontaminate.Items.of(items)
    assert None in own.ids and 90 not in own.ids and own.short == {np.frombuffer("short".encode("utf-32-le"), np.uint32).tobytes(): [90]}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["text"], r["leaks"]) for r in decontaminate.find_leaks(df, bench).collect()]
    for _, text, leaks in got:
        want = {(own.ids[k], e) for k, p in enumerate(own.text) if (e := edits_in("".join(map(chr, p)), normal(text or ""))) <= own.edits[k]}
        best = {}
        for x in leaks:
            best[x["item_id"]] = min(best.get(x["item_id"], 99), x["edits"])
            assert edits_in("".join(map(chr, own.text[own.ids.index(x["item_id"])])), normal(text[x["start"] : x["end"]])) == x["edits"]
        assert set(best.items()) == want
    assert len(got) == len(docs) and decontaminate.find_leaks(df.limit(0), bench).count() == 0
    assert all(not r["leaks"] for r in decontaminate.find_leaks(df, bench.limit(0)).collect())


def test_leaks_of_common_grams(monkeypatch):
    """Ten thousand items that begin alike: hits are counted a bounded number at a time, and give the same."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = decontaminate.Items.of([(i, f"which of the following {word()} {word()} {word()} {word()} {word()}") for i in range(10_000)])
    texts = [f"Which of the following is it? {'which of the following ' * 4}{word()}" for _ in range(4)]
    texts += [f"so -- {bytes(items.text[k].astype(np.uint8)).decode()} -- indeed, which of the following" for k in (3, 777, 9_999)]
    data = [t.encode() for t in texts]
    sizes = np.array([len(x) for x in data])
    most = []
    count = decontaminate._bands
    monkeypatch.setattr(decontaminate, "HITS", 1 << 18)
    monkeypatch.setattr(decontaminate, "_bands", lambda at, doc, lo, hi, *rest: (most.append(int((hi - lo).sum())), count(at, doc, lo, hi, *rest))[1])
    got = decontaminate.leaks_in(b"".join(data), sizes, items)
    assert {x[1] for x in got} == {3, 777, 9_999} and len(most) > 1 and max(most) <= decontaminate.HITS


def test_leaks_of_any_ids(spark):
    bench = [("a-1", "The quick brown fox jumps over the lazy dog today."), ("a-2", "Yes, 42!"), (None, "?!"), ("a-1", "The quick brown fox jumps over the lazy dog today.")]
    docs = [(1, "x The quick brown fox jumps over the lazy dog today y"), (2, "yes 42"), (3, " -- Yes: 42 -- "), (4, "yes 42 of them"), (5, ""), (6, "w " * 400_000 + bench[0][1])]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string"))
    got = {r["doc_id"]: [(x["item_id"], docs[r["doc_id"] - 1][1][x["start"] : x["end"]], x["edits"]) for x in r["leaks"]] for r in found.collect()}
    fox = ("a-1", "The quick brown fox jumps over the lazy dog today", 0)
    assert got == {1: [fox], 2: [("a-2", "yes 42", 0)], 3: [("a-2", "Yes: 42", 0)], 4: [], 5: [], 6: [fox]}


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = [(i, f"item number {i} holds quite some {'words ' * i}of its own") for i in range(6)]
    df = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(i in got[i] for i in range(6))


def test_chunks_hold_every_row():
    column = pa.array([None, "", "a", "b" * 3_000_000, None, "c"])[1:]
    got = [(int(r), data[sum(sizes[:k]) : sum(sizes[: k + 1])]) for rows, data, sizes in bpe._chunks(column) for k, r in enumerate(rows)]
    assert [(r, len(d)) for r, d in got] == [(1, 1), (2, 3_000_000), (4, 1)]
