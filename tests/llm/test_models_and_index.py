"""Models against naive versions, pages written by hand, versions of paths, the stored index, step groups."""

import itertools
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from zetaflow.llm import ann, html_crf, html_extract, minhash, mixing, packing, quality, secrets
from zetaflow.llm.common import table
from zetaflow.llm.html_blocks import blocks

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# Quality.


def plain_score(model, row):
    z = model.base
    cell = [sum(1 for c in cuts if c <= x) for cuts, x in zip(model.cuts, row)]
    for j, t in enumerate(model.single):
        z += t[cell[j]]
    for i, j, t in model.pairs:
        z += t[cell[i]][cell[j]]
    return 1 / (1 + np.exp(-z))


def test_scores_are_sums_of_table_cells(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    x[:, 3] = np.round(x[:, 3])  # ties at the cuts
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert model.pairs and np.allclose(model.score(x), [plain_score(model, r) for r in x], atol=1e-12)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9  # only the pair of both can tell
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    learnt = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.op2_quality(spark, SF).collect()}
    for r in docs.limit(60).collect():
        want = plain_score(learnt, quality.features(r.text or ""))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == int(want >= 0.3)


def test_boosting_follows_the_gradient():
    """A tree's leaves are Newton steps; the loss falls with every round."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 3))
    y = (x[:, 0] + 0.5 * x[:, 2] > 0).astype(float)
    loss = [-np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)) for s in (quality.fit(x, y, rounds=n, pair_rounds=0).score(x) for n in (1, 5, 20))]
    assert loss[0] > loss[1] > loss[2]
    grad, hess = np.array([1.0, 1, -2, -2]), np.array([1.0, 1, 1, 1])
    assert np.allclose(quality._tree(grad, hess, 2, 1.0), [2 / 3, 2 / 3, -4 / 3, -4 / 3])


def test_rejecting_keeps_every_column(spark):
    rows = spark.createDataFrame([(1, "the house and the river", 2.0, "a", 3)], "doc_id long, text string, score double, __text string, __quality int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.reject(rows, labels).collect() == rows.collect()
    model = quality.train(rows, labels)
    assert quality.score_texts(rows, model).columns == ["doc_id", "text", "__text", "__quality", "score"]


def test_texts_go_to_python_once(spark, monkeypatch):
    sent = []
    kind = type(spark.range(0))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, f=kind.mapInArrow, **b: sent.append(self.columns) or f(self, *a, **b))
    rows = spark.createDataFrame([(1, "the house and the river", "b"), (2, None, "c"), (3, "", None), (4, "UP!!! | | | 99", "d")], "Text int, body string, `row` string")
    model = quality.train(rows.withColumnRenamed("Text", "doc_id"), spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"), "body")
    sent.clear()
    got = quality.score_texts(rows, model, "body").collect()
    assert sent == [["row"]]
    want = model.score(np.array([quality.features(r.body or "") for r in rows.collect()]))
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in rows.collect()] and np.allclose([r.score for r in got], want)
    cast = quality.score_texts(rows.select(F.col("body").cast("binary").alias("body")), model, "body").collect()
    assert np.allclose([r.score for r in cast], want)


# Extraction.


def small_field(rng, features=4):
    names = {f"f{i}": i for i in range(features)}
    return html_crf.Crf(names, rng.standard_normal((features, 2)), rng.standard_normal((2, 2)))


def value(crf, page, labels):
    node = crf.scores(page)
    return sum(node[t, y] for t, y in enumerate(labels)) + sum(crf.steps[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_viterbi_against_enumeration(n):
    rng = np.random.default_rng(n)
    for _ in range(10):
        crf = small_field(rng)
        page = [[int(f) for f in np.flatnonzero(rng.random(4) < 0.5)] or [0] for _ in range(n)]
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: value(crf, page, y))
        assert crf.decode([[f"f{i}" for i in b] for b in page]) == list(best)


def test_gradient_against_differences_and_enumeration():
    rng = np.random.default_rng(7)
    crf = small_field(rng)
    page, labels = [[0, 1], [2], [1, 3], [0]], [0, 1, 1, 0]
    got, used, by_weights, by_steps = html_crf.gradient(crf, page, labels)
    every = [value(crf, page, y) for y in itertools.product((0, 1), repeat=4)]
    assert abs(got - (value(crf, page, labels) - np.log(np.sum(np.exp(every))))) < 1e-9
    for array, grad, at in [(crf.weights, by_weights, list(used)), (crf.steps, by_steps, [0, 1])]:
        for i, row in enumerate(at):
            for c in (0, 1):
                array[row, c] += 1e-6
                assert abs((html_crf.gradient(crf, page, labels)[0] - got) / 1e-6 - grad[i, c]) < 1e-4
                array[row, c] -= 1e-6


#: (page, its main text), written without the generator of the training pages.
BY_HAND = [
    (
        """<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Ferry timetable | Harbour Post</title><script>var a = "<p>no</p>";</script></head>
        <body class="home"><header id="top"><a href="/">Harbour Post</a><p>News from the quay</p></header>
        <nav class="menu"><ul><li><a href="/a">Sport</a><li><a href="/b">Weather</a></ul></nav>
        <main><article><h1>The ferry sails again</h1><p>After three weeks in dry dock the ferry returned on Monday, and the first cars rolled aboard before dawn.</p>
        <p>Its captain, who has crossed the sound for twenty years, said the new engine was <em>quieter</em> than the old one &amp; used less fuel.</p>
        <aside class="related"><h4>Read also</h4><ul><li><a href="/c">Bridge plans</a></li></ul></aside>
        <p>Tickets cost the same as before.</p></article></main>
        <section class="comments"><h3>2 comments</h3><p class="comment">Great news, at last!</p><p class="comment">Too loud still.</p></section>
        <footer><p>&copy; Harbour Post. All rights reserved.</p></footer></body></html>""",
        "The ferry sails again After three weeks in dry dock the ferry returned on Monday, and the first cars rolled aboard before dawn. Its captain, who has crossed the sound for twenty years, said the new engine was quieter than the old one & used less fuel. Tickets cost the same as before.",
    ),
    (
        """<html><body><div class="cookie-notice"><p>We use cookies. Accept them?</p></div><div id="sidebar"><h3>Popular</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>
        <div class="post-content"><h2>Bread without kneading</h2><p>Mix flour, water, salt and a little yeast in the evening. Cover the bowl and leave it alone.</p>
        <ul><li>Fold it once in the morning.</li><li>Bake it hot, in a closed pot.</li></ul>
        <blockquote>Time does the work that hands need not do.</blockquote><p>Let the loaf cool before you cut it.</p></div>
        <form class="newsletter"><label>Your address</label><input name=m><select><option>Daily<option>Weekly</select><button>Subscribe</button></form>
        <div class="footer">Imprint &middot; Contact</div></body></html>""",
        "Bread without kneading Mix flour, water, salt and a little yeast in the evening. Cover the bowl and leave it alone. Fold it once in the morning. Bake it hot, in a closed pot. Time does the work that hands need not do. Let the loaf cool before you cut it.",
    ),
    (
        """<body><nav><a href=/>Home</a></nav><article class="story"><h1>Fog</h1><div class="ad"><p>Buy two, get one free.</p></div><p>Fog came in from the sea and lay over the fields, so that the church stood without its tower.
        <p>By noon it was gone.</article><footer class="site-footer">&copy; 2020</footer>""",
        "Fog Fog came in from the sea and lay over the fields, so that the church stood without its tower. By noon it was gone.",
    ),
]


@pytest.mark.parametrize("page,text", BY_HAND)
def test_pages_written_by_hand(page, text):
    assert html_extract.main_text(page, html_extract.default_model()) == text


@pytest.mark.parametrize(
    "page,texts",
    [
        ("<p>one</p><datalist><option value=a><option value=b></datalist><p>two two</p>", ["one", "two two"]),
        ("<p>one<iframe src=x><p>two", ["one", "two"]),
        ("<svg><svg><text>no</text></svg><text>no</text></svg><p>yes", ["yes"]),
        ("<object><object>a</object><p>b</p></object><p>c", ["c"]),
        ("<select><option>a<option>b<p>text", ["text"]),
        ("<head><title>t</title><body><p>a", ["a"]),
        ("<p title=\"open>r</p>s", ["r", "s"]),
        ("<p title='a>b'>q", ["q"]),
        ("<textarea>abc<p>d", ["abc", "d"]),
        ("1 < 2 and <3 <", ["1 < 2 and <3 <"]),
        ("a<!-->b--><p>c", ["a", "c"]),
    ],
)
def test_broken_pages_lose_nothing(page, texts):
    assert [b.text for b in blocks(page)] == texts


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 60_000 + "</section>" * 60_000, "<b>" * 80_000 + "</i>" * 80_000, "<div>x" * 40_000, "<a '>' " * 80_000 + '"', "<li><ul>" + "<div>" * 30_000 + "<li>x</li>" * 30_000, "<!-- " * 200_000, "<svg>" * 80_000, "<title>" * 80_000])
def test_hostile_pages_take_linear_time(page):
    import time

    start = time.process_time()
    blocks(page)
    assert time.process_time() - start < 2


# Secrets.


def test_versions_of_paths_share_a_scan(spark, monkeypatch):
    rows = [("a.txt", 1, "token=abcdef1"), ("a.txt", 2, "nothing"), ("b.txt", 1, "token=abcdef1"), ("c.txt", 1, "secret: hunter22"), ("c.txt", 2, None), ("d.txt", 1, "nothing"), ("b.txt", 1, "token=abcdef1"), (None, None, "token=abcdef1")]
    schema = "path string, version int, text string, blob string, spans string"
    history = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    found, ledger = secrets.scan_versions(history)
    got = {(r.path, r.version): (r.spans, r.current, r.paths) for r in found.collect()}
    token = "assign:0:13"
    assert got == {("a.txt", 1): (token, False, 3), ("b.txt", 1): (token, True, 3), (None, None): (token, True, 3), ("c.txt", 1): ("assign:0:16", False, 1)}
    assert ledger.count() == 3
    later = spark.createDataFrame([("e.txt", 1, "token=abcdef1", "x", "y"), ("a.txt", 3, "AKIA" + "B" * 16, "x", "y")], schema)
    seen = []
    real = secrets.materialize
    monkeypatch.setattr(secrets, "materialize", lambda df: (lambda out: (seen.append(out.count()), out)[1])(real(df)))
    more, again = secrets.scan_versions(later, ledger)
    assert seen == [1]  # the known content isn't read again
    assert {(r.path, r.spans) for r in more.collect()} == {("e.txt", token), ("a.txt", "access:0:20")}
    assert again.count() == 4 and secrets.scan_versions(later, again, rule_version=2)[1].count() == 6
    assert secrets.scan_versions(history.limit(0))[0].count() == 0


# Near-duplicates.


def test_keep_one_with_clashing_names(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words), 5, "x"), (2, " ".join(words) + " more", 6, "y"), (3, "other text " * 3, 7, "z"), (1, " ".join(words), 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, Node string")
    got = minhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_keep_one_leaves_other_classes_alone(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c)]
    got = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a), (2, b), (None, c)]))


def test_recall_against_all_pairs_on_the_real_table(spark):
    """Every pair of different texts with a plain five-word Jaccard of 0.8 or more is in one class."""
    sf = SF.replace("sf0.001", "sf0.01")
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    of = {r.doc_id: r.class_id for r in minhash.op3_near_dedup(spark, sf).collect()}
    sets = [(d, set(minhash.shingles(t or "")[0].tolist())) for d, t in rows]
    found = pairs = 0
    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    near = Counter((i, j) for members in by.values() for i, j in itertools.combinations(members, 2))
    for (i, j), n in near.items():
        if n >= 0.8 * (len(sets[i][1]) + len(sets[j][1]) - n):
            pairs += 1
            found += of[sets[i][0]] == of[sets[j][0]]
    assert pairs > 50 and found >= 0.98 * pairs


# Mixing.


def test_the_mix_reads_blocks_by_its_own_rules(spark):
    """An independent replay: streams in hash order, slots through the permutation, the last one cut."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(int(rng.integers(0, 90)))), str(rng.choice(["a", "b", "c"]))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block = 16
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
    names = sorted({s for _, _, s in rows})
    n_rows = len(rows)
    buckets = max(1, int(n_rows**0.5))
    streams = {}
    for s in names:
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (order[r[0]] % buckets, order[r[0]]))
        streams[s] = [w for r in mine for w in r[1].split()]
    sizes = [len(streams[s]) for s in names]
    plan = mixing.plan(sizes, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), block, mixing.N_SHARDS, mixing.SEED)
    want = Counter()
    for s, p in zip(names, plan):
        for slot in range(p["slots"]):
            b = int(mixing.permute(np.array([slot % p["blocks"]]), p["blocks"], p["keys"])[0])
            take = p["cut_words"] if slot == p["cut_slot"] else block
            want.update(streams[s][b * block : b * block + take])
    got = Counter(w for r in mixing.mix(docs, block_words=block).collect() for w in r.text.split())
    assert got == want and sum(want.values()) > 1000
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(docs, block_words=block).collect()}
    assert taken == {i: sum(n for w, n in want.items() if w.startswith(f"d{i}w")) for i, _, _ in rows}
    whole = Counter(w for r in mixing.mixed_documents(docs, block_words=block).collect() for w in r.text.split())
    assert whole == want


# Search.


def test_recall_on_the_real_table(spark):
    for sf in (SF, SF.replace("sf0.001", "sf0.1")):
        rows = table(spark, sf, "embeddings").select("vec_id", "embedding").toPandas()
        x, ids = np.array(rows["embedding"].tolist(), dtype=np.float32), rows["vec_id"].to_numpy()
        want = ann.brute_force(x, ids, 20, 20)
        got = defaultdict(set)
        for r in ann.op9_nearest(spark, sf).collect():
            got[r.query_id].add(r.vec_id)
        recall = [len(got[q] & set(w)) / len(w) for q, w in want.items()]
        assert np.mean(recall) >= 0.9 and min(recall) >= 0.6


def test_a_stored_index_is_searched_again(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 12))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.build_index(frame)
    assert index.columns == ["shard", "dim", "forest"] and index.count() == 7
    first = ann.Forest.load(bytes(index.first().forest))
    again = ann.Forest.load(first.dump())
    assert (again.order == first.order).all() and (again.sorted == first.sorted).all()
    asked = frame.filter("vec_id < 40").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    want = {r: [j for j in np.argsort(-(x @ x[r]), kind="stable") if j != r][:5] for r in range(40)}
    for lanes in (1, 24):
        monkeypatch.setattr(ann, "LANES", lanes)
        got = defaultdict(list)
        for r in ann.search_index(index, asked, 5, share=1.0).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert got == want  # all candidates: exact


# Packing.


def test_step_groups_hold_equal_tokens(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "delta", "99"], int(rng.integers(0, 900))))) for i in range(600)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), step_tokens=1 << 14).collect()
    groups = defaultdict(int)
    tiers, of = defaultdict(set), {}
    for r in got:
        groups[r.step_group] += r.length
        tiers[r.sequence_id >> 32, r.tier].add(r.step_group)
        assert of.setdefault(r.sequence_id, r.step_group) == r.step_group
    assert sum(len(g) for g in tiers.values()) == len(groups)  # no two tiers or partitions share a number
    for mine in tiers.values():
        sizes = [groups[g] for g in sorted(mine)]
        assert all(n == 1 << 14 for n in sizes[:-1]) and sizes[-1] <= 1 << 14
    assert max(map(len, tiers.values())) > 3
