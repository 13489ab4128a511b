import hashlib
from collections import Counter

import numpy as np
import pytest

from zetaflow.llm import automaton, repeats, suffix_array

DOCS = "doc_id long, text string, lang string, node long, span long, m int, spans string, id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "s", 4) for i, t in rows], DOCS)


def brute(sequences, width):
    seen = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def corpus():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdé"), int(rng.integers(2, 7))))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(45)
    rows = [(i, text(int(rng.integers(0, 120)))) for i in range(30)]
    rows += [(100 + i, f"{text(20)} {passage} {text(20)}") for i in range(25)]
    rows += [(200 + i, f"{text(int(rng.integers(0, 40)))} {other}\n{other} {passage[:250]}") for i in range(3)]
    long = text(3000)
    rows += [(300, long), (301, long.replace("a", "b", 5)), (302, text(100) + " " + long[4000:9000])]
    rows += [(400, "x " * 500), (401, "y z " * 30), (402, "q" * 199), (403, "w" * 450), (404, None), (405, ""), (None, passage), (300, long), (406, "a b\x1cc\xa0d " * 40)]
    return rows


def strain(monkeypatch, hot, module):
    """Cut almost every minimiser finer, join almost every key by broadcast, and let unit hashes collide."""
    monkeypatch.setattr(repeats, "HOT_FRAGMENTS", hot)
    if hot == 2:
        monkeypatch.setattr(repeats, "HEAVY_ROWS", 2)
        for name in ("TEXTS", "RANGES"):
            reader = getattr(module, name)
            monkeypatch.setattr(module, name, reader._replace(hashes=(lambda f: lambda x: (lambda u, raw: (u % np.uint64(3), raw))(*f(x)))(reader.hashes)))


@pytest.mark.parametrize("hot", [2, 1000])
def test_words_against_brute_force(spark, monkeypatch, hot):
    strain(monkeypatch, hot, automaton)
    rows = corpus()
    sequences = [automaton.words(t or "") for _, t in rows]
    want = sorted((str(i), len(s), sum(g), hashlib.sha256(" ".join(w for w, x in zip(s, g) if not x).encode()).hexdigest()) for (i, _), s, g in zip(rows, sequences, brute(sequences, 35)))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in automaton.dedup_words(docs(spark, rows)).collect())
    assert got == want and sum(x[2] for x in want) > 1000


@pytest.mark.parametrize("hot", [2, 1000])
def test_bytes_against_brute_force(spark, monkeypatch, hot):
    strain(monkeypatch, hot, suffix_array)
    rows = corpus()
    sequences = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), s, g in zip(rows, sequences, brute(sequences, 200)):
        runs = sum(b and not a for a, b in zip([False, *g], g))
        want.append((str(i), len(s), sum(g), runs, hashlib.sha256(bytes(c for c, x in zip(s, g) if not x)).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.dedup_bytes(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 5000


def test_empty_tables(spark):
    assert automaton.dedup_words(docs(spark, [])).count() == 0
    assert suffix_array.dedup_bytes(docs(spark, [(1, None)])).first().n_bytes == 0


def test_automaton_counts_occurrences():
    a = automaton.Automaton()
    rng = np.random.default_rng(3)
    sequences = [list(rng.integers(0, 3, int(rng.integers(1, 30)))) for _ in range(20)]
    weights = [int(w) for w in rng.integers(1, 3, 20)]
    for s, w in zip(sequences, weights):
        a.add(s, w)
    a.close()
    seen = Counter()
    for s, w in zip(sequences, weights):
        for i in range(len(s)):
            for j in range(i, len(s)):
                seen[tuple(s[i : j + 1])] += w
    for s in sequences:
        want = [max((k for k in range(1, i + 2) if seen[tuple(s[i + 1 - k : i + 1])] >= 4), default=0) for i in range(len(s))]
        assert a.statistics(s, 4) == want


def test_long_texts_are_cut_without_loss(monkeypatch):
    u = repeats.mix(np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint64))
    read = [(u[:30], u[:30].tobytes()), (u, u.tobytes()), (u[40:90], u[40:90].tobytes())]
    at = lambda f: {(int(o), (s >> 20) + k): (int(a), (s & 1023) - k) for o, a, s in zip(f[0], f[1], f[3].tolist()) for k in range(s >> 10 & 1023)}
    whole = repeats._chunk_fragments(read, 35, 8)
    monkeypatch.setattr(repeats, "_PART", 700)
    monkeypatch.setattr(repeats, "_PLACE_BITS", 11)
    parts = repeats._chunk_fragments(read, 35, 8)
    assert at(whole) == at(parts) and len(at(whole)) == 5000 - 34 + 50 - 34
    alone = repeats._chunk_fragments(read[2:], 35, 8)
    assert {k[1]: v for k, v in at(whole).items() if k[0] == 2} == {k[1]: v for k, v in at(alone).items()}


def bucket_of_one_minimiser(n):
    """Fragments around one gram: some equal, some alike on one side, some periodic."""
    rng = np.random.default_rng(n)
    letters = lambda k: bytes(rng.integers(97, 100, k).astype(np.uint8))
    sides = [letters(130) for _ in range(4)] + [b"ab" * 65]
    units, places = [], []
    for i in range(n):
        left, right = (sides[int(rng.integers(5))] if rng.random() < 0.5 else letters(130) for _ in range(2))
        place = int(rng.integers(60, 130))
        units.append((left + b"minimiser" + right)[130 - place :][: 200 + int(rng.integers(1, 60))])
        places.append(place)
    units = [u if len(u) >= 200 else u + letters(200 - len(u)) for u in units]
    windows = np.array([len(u) - 199 for u in units])
    return units, rng.integers(1, 3, n) // 2 + 1, np.array(places), windows


def test_a_bucket_sorted_in_parts_is_that_sorted_at_once(monkeypatch):
    units, weights, places, windows = bucket_of_one_minimiser(300)
    seen = Counter()
    for u, m, p, n in zip(units, weights.tolist(), places.tolist(), windows.tolist()):
        for j in range(n):
            seen[p - j, u[j : j + 200]] += m
    want = [[seen[p - j, u[j : j + 200]] > 1 for j in range(n)] for u, p, n in zip(units, places.tolist(), windows.tolist())]
    sizes, old = [], suffix_array.Block.classes
    monkeypatch.setattr(suffix_array, "SORTED", 500)
    monkeypatch.setattr(suffix_array.Block, "classes", lambda self, at: sizes.append(len(at)) or old(self, at))
    got = [m.tolist() for m in suffix_array.sort_bucket(units, weights, places, windows)]
    assert got == want and 0 < sum(map(sum, want)) < sum(windows)
    assert len(sizes) > 3 and sum(sizes) == sum(windows) and max(sizes) < 2 * 500


def test_bytes_cut_finer_only_beyond_the_room_of_a_bucket(spark, monkeypatch):
    """The same bytes go whichever way; cutting finer costs several tables of units."""
    monkeypatch.setattr(repeats, "HOT_FRAGMENTS", 10)
    cut, old = [], repeats._finer
    monkeypatch.setattr(repeats, "_finer", lambda *a: cut.append(a[2]) or old(*a))
    found = lambda: sorted(str(tuple(r)) for r in suffix_array.dedup_bytes(docs(spark, corpus())).collect())
    got = found()
    assert not cut
    monkeypatch.setattr(suffix_array, "ROOM", 1)
    assert found() == got and cut


def test_cover_is_a_difference_cover():
    p, cover = suffix_array.PERIOD, suffix_array.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p)) and len(cover) * (len(cover) - 1) == p - 1


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_block_sort_against_a_plain_sort(letters):
    rng = np.random.default_rng(letters)
    data = rng.integers(0, letters, 5000).astype(np.uint8) + 97
    data[1000:2500] = data[3000:4500]
    data[4600:4900] = 97
    raw, at = data.tobytes(), rng.permutation(4700)[:3000]
    block = suffix_array.Block(data, 200)
    order, _ = block.order(at)
    found = [raw[at[i] : at[i] + 200] for i in order]
    assert found == sorted(found)
    classes = block.classes(at)
    assert len({(raw[a : a + 200], int(c)) for a, c in zip(at, classes)}) == len(set(classes)) == len({raw[a : a + 200] for a in at})


def test_what_stays(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join("".join(rng.choice(list("abcdef"), 6)) for _ in range(n))
    shared, own = text(40), [text(5), text(6)]
    rows = [(1, f"{own[0]} {shared}"), (2, f"{shared}  {own[1]}"), (None, None)]
    got = {r.doc_id: r.kept for r in automaton.kept_words(docs(spark, rows)).collect()}
    assert got == {1: own[0], 2: own[1], None: ""}
    got = {r.doc_id: r.kept for r in suffix_array.kept_bytes(docs(spark, rows)).collect()}
    assert got == {1: own[0] + " ", 2: "  " + own[1], None: ""}  # the first text has no blank behind the passage, the second two


@pytest.mark.parametrize(("module", "dedup"), [(automaton, "dedup_words"), (suffix_array, "dedup_bytes")])
def test_written_tables_lie_in_few_files(spark, monkeypatch, module, dedup):
    """However many partitions joins deal to: each file costs processes that the executor's JVM starts."""
    monkeypatch.setattr(repeats, "HOT_FRAGMENTS", 10)
    cores = spark.sparkContext.defaultParallelism
    frame = docs(spark, corpus()).coalesce(cores)
    result = lambda df: sorted(str(tuple(r)) for r in df.collect())
    want = result(getattr(module, dedup)(frame))
    written, old = [], repeats.materialize
    monkeypatch.setattr(repeats, "materialize", lambda df: written.append(len((out := old(df)).inputFiles())) or out)
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = getattr(module, dedup)(frame)
        assert out.rdd.getNumPartitions() <= cores
        assert result(out) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(written) > 10 and max(written) <= cores


def test_marks_of_whole_copies_come_from_the_automaton(spark, monkeypatch):
    """Without the automaton's answers nothing is removed, however often a text occurs."""
    rows = [(i, " ".join(f"w{j}" for j in range(80))) for i in range(5)]
    assert {r.n_removed for r in automaton.dedup_words(docs(spark, rows)).collect()} == {80}
    monkeypatch.setattr(automaton, "match_shard", lambda units, weights, places, windows: [np.zeros(n, bool) for n in windows])
    assert {r.n_removed for r in automaton.dedup_words(docs(spark, rows)).collect()} == {0}
