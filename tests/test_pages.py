"""Names, matches, edits, paragraphs, editions, geometry, attempts and hand-offs on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from zetaflow.functions import geometry, names
from zetaflow.functions import text as T
from zetaflow.operators import editing, ingest
from zetaflow.sources import files
from zetaflow.sources.state import Locked, State, cached

WORDS = "array<struct<t: string, x: double, y: double, w: double, h: double>>"

TITLES = {
    "cellar/Stews of the North (z-library.sk, 1lib.sk).pdf": "Stews of the North",
    "Stews (Z-Library) (3rd ed.).pdf": "Stews (3rd ed.)",
    "Stews (A. Cook, ed.) [libgen].epub": "Stews (A. Cook, ed.)",
    "Stews (2).pdf": "Stews",
    "Stews (1987).pdf": "Stews (1987)",
    "Stews - z-lib.org.pdf": "Stews",
    "Stews 9781234567897.pdf": "Stews",
    "Stews 1a2b3c4d5e.pdf": "Stews",
    "Stews 1924-2003.pdf": "Stews 1924-2003",
    "Ann Lee - Stews_text_ocr.pdf": "Ann Lee - Stews",
    "Stews copy 12.pdf": "Stews",
    "half-open.pdf": "half-open",
    "a-book-of-northern-stews.pdf": "A Book of Northern Stews",
    "the.book.of.northern.stews.pdf.pdf": "The Book of Northern Stews",
    "Vol.3.pdf": "Vol.3",
    "stews.pdf": "Stews",
    "scan.pdf": "Scan",
    "northernstew00anon.pdf": "northernstew00anon",
    "b1234_0002 (libgen).pdf": "b1234_0002",
    "Stews (open [note.pdf": "Stews (open [note",
    "(libgen).pdf": "(libgen)",
    ".hidden": "hidden",
    "": "",
}


def test_titles(spark):
    frame = spark.createDataFrame([(p,) for p in TITLES] + [(None,)], "p string")
    got = {r.p: r.t for r in frame.select("p", names.file_title(F.col("p")).alias("t")).collect()}
    assert got == TITLES | {None: None}
    assert names.clean("half-open", slug=True) == "Half Open" and names.clean("half-open") == "half-open"
    assert names.opaque("bub_xkcdq_wTLL") and not names.opaque("a b") and not names.opaque("northern-stews")


def plain_match(label, query):
    q, low = query.strip().lower(), label.lower()
    if not q:
        return 0.0, []
    at, places = 0, []
    for c in q.replace(" ", ""):
        at = low.find(c, at)
        if at < 0:
            return None
        places.append(at)
        at += 1
    score = 10.0 * (q in low) - 0.05 * len(label)
    for i, p in enumerate(places):
        before = places[i - 1] if i else -1
        score += 18 if p == 0 else 12 if low[p - 1] in " -_·/([.,:;'\"" else 8 if i and p == before + 1 else 1 - min(p - before - 1, 6)
    marked = set(places)
    starts, ends = [p for p in places if p - 1 not in marked], [p + 1 for p in places if p + 1 not in marked]
    return round(score, 6), list(zip(starts, ends, strict=True))


def test_subsequences(spark):
    r = random.Random(5)
    labels = ["".join(r.choice("abAB -·'") for _ in range(r.randrange(14))) for _ in range(150)] + ["Anchor · Salt", ""]
    asked = [(x, "".join(r.choice("abb ") for _ in range(r.randrange(4)))) for x in labels] + [("Anchor · Salt", "sa"), ("x", None), (None, "x")]
    frame = spark.createDataFrame(asked, "l string, q string").select("l", "q", T.subsequence(F.col("l"), F.col("q")).alias("m"))
    for row in frame.collect():
        want = plain_match(row.l, row.q) if row.l is not None and row.q is not None else None
        got = row.m and (round(row.m.score, 6), [(s.start, s.end) for s in row.m.spans])
        assert got == want, row


def test_edits(spark):
    def run(words, *edits):
        frame = spark.createDataFrame([(words, list(edits))], "w array<string>, e array<struct<original: string, corrected: string, verified: boolean>>")
        done = frame.select(editing.apply_edits(F.col("w"), F.col("e")).alias("r")).first().r
        return [w.t for w in done.words], [w.src for w in done.words], done.verdicts

    assert run(["(thc", "sea,"], ("thc sea", "the sea", True)) == (["(the sea,"], [0], ["applied"])
    assert run(["sal", "ty", "air"], ("sal ty", "salty", True), ("salty", "saltier", True)) == (["salty", "air"], [0, 2], ["applied", "edit distance"])
    assert run(["a", "thc)", "sea"], ("thc sea", "the sea", True))[2] == ["no anchor"]  # a mark inside the span
    assert run(["ä" * 8], ("ä" * 8, "ä" * 6, True), ("ä" * 8, "ä" * 7, True))[2] == ["applied", "no anchor"]  # 4 of 16 bytes
    assert run(["x", "x"], ("x", "x y", True)) == (["x y", "x"], [0, 1], ["applied"])
    assert run(["go", "of", "on"], ("go", "go of", True), ("on", "of on", True))[2] == ["duplicates next word", "duplicates previous word"]
    assert run(["a"], (" ", "a", True), (None, "a", True), ("a", "b", None), ("a" * 41, "a", True), ("a", "b" * 49, True))[2] == ["no anchor", "noop", "unverified", "too long", "too long"]
    assert run([], ("a", "b", True)) == ([], [], ["no anchor"])
    nothing = spark.range(1).select(editing.apply_edits(F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<original: string, corrected: string, verified: boolean>>")).alias("r"))
    assert nothing.first().r.words == [] and nothing.first().r.verdicts == []


def page(*lines):
    """Words of lines (step down, indent, text)."""
    out, y = [], 0.0
    for step, indent, text in lines:
        y += step
        out += [(t, 0.1 + indent + 0.05 * i, y + 0.002 * (i % 2), 0.04, 0.012) for i, t in enumerate(text.split())]
    return out


PAGES = [
    ("b", 2, page((0.02, 0, "the harbour- master of"), (0.02, 0, "half- open boats"), (0.02, 0.03, "well -- she said -"), (0.02, 0, "go"))),
    ("b", 1, page((0.02, 0, "our harbourmaster and"), (0.02, 0, "more of"), (0.06, 0, "un- der- stand Twi- Light"), (0.02, 0, "-"), (0.02, 0, "of"))),
    ("a", 1, page((0.02, 0, "harbour- master understand"))),  # the other document's word doesn't count
    ("c", 1, None),
    ("c", 2, []),
]


def test_paragraphs_and_editions(spark):
    frame = spark.createDataFrame(PAGES, f"doc string, page int, words {WORDS}")
    got = {r.doc: r.body for r in editing.editions(frame).collect()}
    assert got == {
        "a": "# a\n\n<!-- page 1 -->\n\nharbour-master understand\n",
        "b": "# b\n\n<!-- page 1 -->\n\nour harbourmaster and more of\n\nun-der-stand Twi- Light - of\n\n<!-- page 2 -->\n\nthe harbourmaster of half-open boats\n\nwell -- she said - go\n",
        "c": "# c\n\n<!-- page 1 -->\n\n<!-- page 2 -->\n",
    }
    assert editing.editions(frame.limit(0)).count() == 0
    one = frame.filter("doc = 'b' and page = 1").select(editing.paragraphs(F.col("words")).alias("p")).first().p
    assert [p[0] for p in one] == ["our", "un-"]


def test_editions_as_files(spark, tmp_path):
    at = str(tmp_path / "text")
    rows = lambda *r: spark.createDataFrame(list(r), "doc string, body string")
    files.write_editions(rows(("a", "# a\n\nold\n"), ("b/c", "# b\n")), at)
    files.write_editions(rows(("a", "# a\n\nnew\n")), at)
    assert {r.doc: r.body for r in files.read_editions(spark, at).collect()} == {"a": "# a\n\nnew\n", "b/c": "# b\n"}


def test_geometry(spark):
    frame = spark.createDataFrame(PAGES, f"doc string, page int, words {WORDS}").select("*", geometry.line_boxes(F.col("words")).alias("boxes"), geometry.median_line_height(F.col("words")).alias("height"), geometry.selection_text(F.col("words")).alias("text"))
    rows = {(r.doc, r.page): r for r in frame.collect()}
    first = rows["b", 1].boxes
    assert len(first) == 5 and first[1].y == pytest.approx(0.04) and first[1].h == pytest.approx(0.014) and first[1].w == pytest.approx(0.09)
    assert rows["c", 2].boxes == [] and rows["c", 2].height == 0.02 and rows["a", 1].text == "harbour- master understand"
    box = spark.range(1).select(geometry.drag_box(F.lit(0.5), F.lit(-1.0), F.lit(0.25), F.lit(0.5)).alias("b")).select("b", geometry.negligible(F.col("b")).alias("n")).first()
    assert (box.b.x, box.b.y, box.b.w, box.b.h, box.n) == (0.25, 0.0, 0.25, 0.5, False)

    def drag(word, y, was):
        press = F.struct(F.lit(0.12).alias("x"), F.lit(0.025).alias("y"), F.lit(word).cast("int").alias("word"))
        at = F.struct(F.lit(0.13).alias("x"), F.lit(y).cast("double").alias("y"))
        return frame.filter("doc = 'b' and page = 1").select(geometry.drag(F.col("words"), press, at, F.lit(was), F.col("height")).alias("d")).first().d

    text = drag(0, 0.045, True)
    assert (text.mode, text.w0, text.w1, len(text.boxes), text.bbox) == ("text", 0, 4, 2, None)
    assert drag(None, 0.045, True).mode == "region" and drag(0, 0.6, True).mode == "region"
    # just past the last line: text stays text, a region doesn't turn back
    assert drag(0, 0.172, True).mode == "text" and drag(0, 0.172, False).mode == "region"


def test_attempts(spark):
    rows = [
        (None, True, "done", "done", None, "ready", "ready", None),
        (None, True, "locked", None, None, "staged", "staged", "text"),
        ("text_ready", True, None, "locked", None, "text_ready", "staged", "figures"),
        ("staged", True, "done", "done", "figures", "deleted", "cancelled", None),
        ("text_ready", True, None, "done", "text", "deleted", "cancelled", None),
        ("queued", True, "unprepared", "done", "text", "failed", "failed", None),
        ("queued", True, None, "done", None, "failed", "failed", None),
        ("queued", False, "done", "done", None, "queued", "skipped", None),
        ("deleted", True, "done", "done", None, "deleted", "ready", None),
    ]
    frame = spark.createDataFrame(rows, "state string, claimed boolean, text string, figures string, removed string, a string, b string, c string")
    for r in frame.select("a", "b", "c", ingest.next_state(*(F.col(c) for c in ("state", "claimed", "text", "figures", "removed"))).alias("s")).collect():
        assert (r.s.state, r.s.outcome, r.s.resume) == (r.a, r.b, r.c)


def test_running_sums_over_ranges(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(5), r.randrange(100)) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc int, at int, bytes long").repartition(7)
    got = {x.doc: x.before for x in ingest.running_before(frame, ["at", F.desc("bytes"), "doc"], "bytes", "before").collect()}
    total, want = 0, {}
    for doc, _, size in sorted(rows, key=lambda x: (x[1], -x[2], x[0])):
        want[doc], total = total, total + size
    assert got == want
    assert ingest.running_before(frame.limit(0), ["doc"], "bytes", "before").count() == 0


def test_staged_records(spark, tmp_path):
    at = str(tmp_path / "staged")
    rows = lambda *r: spark.createDataFrame(list(r), "doc string, idx int")
    assert files.staged_records(spark, at, "doc") is None
    files.stage_records(rows(("a", 0), ("a", 1), ("b", 0)), at, 1)
    files.stage_records(rows(("a", 7)), at, 2)
    files.stage_records(rows(("a", 7)), at, 2)
    assert sorted((r.doc, r.idx, r.batch) for r in files.staged_records(spark, at, "doc").collect()) == [("a", 7, 2), ("b", 0, 1)]
    files.clear_staged(spark, at, [1])
    assert [(r.doc, r.idx) for r in files.staged_records(spark, at, "doc").collect()] == [("a", 7)]
    files.clear_staged(spark, at, [2])
    assert files.staged_records(spark, at, "doc") is None


def test_cached_tables(spark, tmp_path):
    state, calls = State(spark, str(tmp_path / "cache")), []

    def build(n):
        return lambda: (calls.append(n), spark.range(n))[1]

    assert cached(state, "map", "v1", build(3)).count() == 3
    assert cached(state, "map", "v1", build(4)).count() == 3 and calls == [3]
    assert cached(state, "map", "v2", build(5)).count() == 5 and calls == [3, 5]
    other = State(spark, state.root)
    other.lock()
    with pytest.raises(Locked):
        cached(state, "map", "v3", build(6))
    assert cached(state, "map", "v2", build(7)).count() == 5
    other.unlock()
