import hashlib
import re
import zlib

import numpy as np

from zetaflow.llm import ann, html_extract, quality, secrets
from zetaflow.llm.html_blocks import blocks
from zetaflow.llm.html_pages import labelled_page

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, blob string, t string, id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 9.0, "b", "t", 1) for i, t in rows], DOCS)


def brute_spans(text):
    out = []
    rules = [r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]
    for k, rule in enumerate(rules):
        for m in re.finditer(rule, text, re.A):
            if (k == 0 and len(m[2]) >= 6) or (k == 1 and len(m[0]) >= 20) or (k == 2 and len(m[0]) >= 24):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secrets_against_brute_force(spark):
    texts = [None, "", "é password: 'hunter22' x", "PassWord=abc token : ABCDEF", "secret: token: abcdefgh", "api_key=AKIA" + "A" * 16, "0" * 23 + " " + "a" * 24, "apKey=abcdefg", "x AKIAAKIA" + "B" * 9, "-----BEGIN RSA PRIVATE KEY-----", "word " * 60_000 + "token=abcdefghij", "ghp_" + "a" * 36]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[2]), (2, texts[2])]
    found, ledger = secrets.scan_secrets(docs(spark, rows))
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            continue
        want = brute_spans(texts[r.doc_id] or "")
        names = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(filter(None, names.split(","))) <= set(r.spans.split(","))
    assert ledger.count() == len({t or "" for t in texts})
    more, again = secrets.scan_secrets(docs(spark, [(1, texts[3]), (2, "new secret=abcdefg")]), ledger)
    assert again.count() == ledger.count() + 1 and {r.n_assign for r in more.collect()} == {1}
    assert secrets.scan_secrets(docs(spark, []))[0].count() == 0


def test_quality_learns_only_the_training_fold(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = rng.choice(["the", "house", "and", "river", "is", "green", "of"], 60)
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good) if zlib.crc32(str(i).encode()) % 5 else 1 - int(good), 0))  # labels of the held-out fold lie
    rows += [(1000, None), (1001, ""), (None, "the house"), (5, rows[5][1]), (1002, "word " * 50_000)]
    got = quality.classify(docs(spark, rows), spark.createDataFrame(labels + [(2000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            if r.doc_id < 600:
                assert r.predicted == int(r.doc_id % 3 > 0)
    assert quality.classify(docs(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    none = quality.classify(docs(spark, rows[:3]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r.score for r in none} == {0.5}


def test_blocks():
    page = "<!doctype html><head><title>t</title></head><body><!-- x <p>no</p> --><script>var t='</p>';</script><p>a&amp;b <b>c</b>d<br>e<p>second\n\n line<ul><li>x<li>y</ul><div class='Side-Bar1'>&copy; z"
    got = blocks(page)
    assert [b.text for b in got] == ["a&b cd e", "second line", "x", "y", "© z"]
    assert got[-1].names == ("side", "bar") and blocks("") == [] and blocks("<!-- open <p>gone") == [] and blocks("<p><script>gone") == []


def test_extraction_on_held_out_pages(spark):
    model = html_extract.default_model()
    wrong = total = 0
    for seed in range(50_000, 50_100):
        page, labels = labelled_page(seed)
        feats = html_extract.page_features(page)[1]
        if len(feats) == len(labels):
            wrong += sum(a != b for a, b in zip(model.decode(feats), labels, strict=True))
            total += len(labels)
    assert total > 1000 and wrong <= 0.01 * total
    page = "<html><nav><ul><li><a href=x>menu</a></ul></nav><article><h1>Title here</h1><p>First para, with words. More words here.</p><div class=ad>Buy now.</div><p>Second &eacute;.</p></article><footer>&copy; someone</footer>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p>" + "long text here. " * 20_000, "x"), (3, "w", page, "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in got if r.page_id == 1] == ["Title here First para, with words. More words here. Second é."]
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and got[1].text == ""
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:140] = x[99]  # a group of equal vectors
    ids = np.arange(1500)
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [1.0] * 3), (None, [1.0] * 16), (7, x[7].tolist())]
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)] + [(i, v, 0) for i, v in bad]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = ann.search(frame).collect()
    want = ann.brute_force(x, ids, 20, 20)
    mine = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want}
    assert {r.query_id for r in got} == set(want) and all(len(v) == 20 for v in mine.values())
    recall = np.mean([len(set(mine[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.9
    for r in got:
        assert abs(r.score - float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float))) < 1e-9
    assert mine[100][:10] == want[100][:10]
    few = ann.search(frame.filter("vec_id in (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]
    assert ann.search(frame.filter("vec_id = 2000")).count() == 0 and ann.search(frame.limit(0)).count() == 0
