import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import SF, compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from zetaflow.llm import minhash, mixing, quality, registry  # noqa: E402
from zetaflow.llm.common import table  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, band long, comp int, class_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "n", 1, 2, 3) for i, t in rows], DOCS)


def corpus():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8)))) for _ in range(4000)]
    text = lambda n: list(rng.choice(words, n))
    rows = [(i, " ".join(text(int(rng.integers(6, 150))))) for i in range(60)]
    for g in range(4):
        base = text(200)
        for c in range(12):
            copy = list(base)
            for _ in range(int(rng.integers(0, 9))):
                copy[int(rng.integers(0, 200))] = str(rng.choice(words))
            rows.append((1000 + 100 * g + c, " ".join(copy)))
    passage = text(50)
    rows += [(2000 + i, " ".join(text(80) + passage + text(80))) for i in range(20)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "One  two"), (3005, "one three"), (None, rows[0][1]), (5, rows[5][1]), (3006, " ".join(text(30_000)))]
    return rows


def brute_classes(rows, idf, least=0.8):
    w = [minhash.weights(t or "", idf) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (len(w[i][0]) and len(w[j][0]) and minhash.similarity(w[i], w[j]) >= least):
                parent[root(i)] = root(j)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[root(i)].append(d)
    return {i: min((d for d in out[root(i)] if d is not None), default=None) for i in range(len(rows))}


@pytest.mark.parametrize("block", [3, 2000])
def test_classes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 1 if block == 3 else 2)
    rows = corpus()
    frame = docs(spark, rows)
    idf = minhash.document_frequencies(frame.select("text").fillna(""))
    want = brute_classes(rows, idf)
    got = minhash.near_duplicates(frame).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted((str(d), str(want[i])) for i, (d, _) in enumerate(rows))
    kept = minhash.keep_one(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {c for c in want.values()}


def test_written_tables_lie_in_few_files(spark, monkeypatch):
    """However many partitions joins deal to: each file costs processes that the executor's JVM starts."""
    written, old = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df: written.append(old(df)) or written[-1])
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rows, cores = corpus(), spark.sparkContext.defaultParallelism
    frame = docs(spark, rows).coalesce(cores)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = minhash.near_duplicates(frame)
        assert out.rdd.getNumPartitions() <= cores
        kept = {r.doc_id for r in minhash.keep_one(frame).collect()}
        got = sorted((str(r.doc_id), str(r.class_id)) for r in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(written) > 20 and max(len(t.inputFiles()) for t in written) <= cores
    want = brute_classes(rows, minhash.document_frequencies(frame.select("text").fillna("")))
    assert got == sorted((str(d), str(want[i])) for i, (d, _) in enumerate(rows)) and kept == set(want.values())


def test_empty_table(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_samples_estimate_the_similarity():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.choice([1.0, 1.69, 0.5], len(h))
    a, b = (h[:300], w[:300]), (h[100:], w[100:])
    many = np.mean([(minhash.samples(minhash._mix(a[0] + np.uint64(s)), a[1]) == minhash.samples(minhash._mix(b[0] + np.uint64(s)), b[1])).mean() for s in range(40)])
    same_order = minhash.similarity(a, b)
    assert abs(many - same_order) < 0.05


def test_common_shingles_weigh_less(spark):
    common = "a very common line of text here"
    rows = [(i, f"{common} {i} x{i} y{i} z{i} u{i} v{i}") for i in range(200)]
    idf = minhash.document_frequencies(docs(spark, rows).select("text"))
    assert idf(minhash.shingles(common)[0]).max() < 0.2 and idf(minhash.shingles(rows[7][1])[0]).max() == 1.0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (70, 2)) if a != b] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_registered_queries_with_sql(spark):
    for name, sql in registry.oracle_sql().items():
        compare(spark, registry.queries()[name], sql)


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).filter("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(right) > 50 and sum(right) >= 0.95 * len(right)
    assert np.mean([r.predicted for r in got if r.quality]) >= 0.98


def test_pipeline_stages(spark):
    rows = table(spark, SF, "documents")
    seen = {"documents": rows.collect()}
    frame = rows
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        if name != "packing":
            assert out.schema.names == rows.schema.names
        seen[name] = out.collect()
        frame = spark.createDataFrame(seen[name], out.schema)
    ids = lambda n: [r.doc_id for r in seen[n]]
    labels = table(spark, SF, "labels")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    predicted = {r.doc_id for r in quality.classify(rows, labels).filter("predicted = 1").collect()}
    assert set(ids("quality")) == predicted and len(good & predicted) >= 0.97 * len(good)
    by_text = defaultdict(list)
    for r in seen["quality"]:
        by_text[r.text].append(r.doc_id)
    assert sorted(ids("exact_dedup")) == sorted(max(x) for x in by_text.values())
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(seen["exact_dedup"], rows.schema)).collect()}
    assert sorted(ids("near_dedup")) == sorted(set(classes.values()))
    counts = {r.doc_id: (r["size"], r.taken) for r in mixing.mix_counts(spark.createDataFrame(seen["near_dedup"], rows.schema)).collect()}
    taken = defaultdict(int)
    for r in seen["mixing"]:
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(taken[d] == t for d, (_, t) in counts.items())
    sequences = defaultdict(int)
    for r in seen["packing"]:
        sequences[r.sequence_id] += r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())
    assert zlib.crc32(b"") == 0 and sum(sequences.values()) == sum(r.length for r in seen["packing"])


def edited(base, words, n, rng):
    """``base`` with ``n`` words, far enough apart, replaced by new ones: 5n of its shingles change."""
    out = list(base)
    for i in rng.permutation(np.arange(5, len(base) - 5, 10))[:n]:
        out[i] = str(rng.choice(words)) + str(rng.integers(10**9))
    return " ".join(out)


def plain_jaccard(a, b):
    a, b = (set(minhash.shingles(t)[0].tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("rounds,block", [(2, 2000), (0, 3)])
def test_a_group_of_a_third_of_all_rows_stays_together(spark, monkeypatch, rounds, block):
    """Its own shingles are the common ones then; members are 0.82 to 0.9 alike in plain five-word Jaccard."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    base = list(rng.choice(words, 300))
    group = [edited(base, words, 4, rng) for _ in range(20)]
    others = [" ".join(rng.choice(words, 300)) for _ in range(40)]
    every = [plain_jaccard(a, b) for i, a in enumerate(group) for b in group[:i]]
    assert 0.7 < min(every) and max(every) < 0.95 and sum(x >= 0.8 for x in every) > 0
    rows = [(i, t) for i, t in enumerate(group + others)]
    idf = minhash.document_frequencies(docs(spark, rows).select("text"))
    parent = list(range(len(group)))
    for _ in parent:  # smallest member each one is linked to
        for i in range(len(group)):
            for j in range(len(group)):
                if plain_jaccard(group[i], group[j]) >= 0.8:
                    parent[i] = min(parent[i], parent[j])
    assert any(p != i for i, p in enumerate(parent))
    assert brute_classes(rows, idf) != {i: (parent[i] if i < 20 else i) for i in range(60)}  # the idf alone loses links
    if not rounds:
        monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 1)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: (parent[i] if i < 20 else i) for i in range(60)}


def test_two_rows_are_found_as_in_a_large_table(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    base = list(rng.choice(words, 300))
    pair = [" ".join(base), edited(base, words, 3, rng)]
    assert 0.88 < plain_jaccard(*pair) < 0.92
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, list(enumerate(pair)))).collect()}
    assert got == {0: 0, 1: 0}


def test_keep_one_decides_by_row(spark):
    """Null and repeated identifiers in different classes; one row of each class stays."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(5000)]
    base = [list(rng.choice(words, 200)) for _ in range(8)]
    whole, near = [" ".join(b) for b in base], [edited(b, words, 1, rng) for b in base]
    rows = [(1, whole[0]), (None, near[0]), (None, whole[1])]  # the second null is a class of its own
    rows += [(2, whole[2]), (3, near[2]), (3, whole[3])]  # 3 loses in one class and is alone in another
    rows += [(4, whole[4]), (4, near[4])]  # two near copies share the smallest identifier
    rows += [(5, whole[5]), (5, whole[5]), (6, near[5])]  # the kept row is repeated
    rows += [(None, whole[6]), (None, near[6]), (7, whole[7])]  # a class without identifiers
    got = minhash.keep_one(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    sure = [(1, whole[0]), (None, whole[1]), (2, whole[2]), (3, whole[3]), (5, whole[5]), (7, whole[7])]
    either = [{(4, whole[4]), (4, near[4])}, {(None, whole[6]), (None, near[6])}]
    assert len(got) == 8 and all(got.count(r) == 1 for r in sure) and all(sum(r in got for r in e) == 1 for e in either)
