"""Documents to chunks, file reconciliation, shelves, cache policy, page geometry, text audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.state import keep

WINDOW_WORDS, STRIDE_WORDS = 200, 160


def chunks(pages: DataFrame, key: list[str], words: Column, size: int = WINDOW_WORDS, stride: int = STRIDE_WORDS) -> DataFrame:
    """Windows of words within a page: key, idx from 0, words. The last is the first that reaches the end; no words, no window."""
    w = pages.select(*key, words.alias("_w")).filter(F.size("_w") > 0)
    count = F.when(F.size("_w") <= size, 1).otherwise(F.ceil((F.size("_w") - size) / stride) + 1).cast("int")
    w = w.withColumn("idx", F.explode(F.sequence(F.lit(0), count - 1)))
    return w.select(*key, "idx", F.slice("_w", F.col("idx") * stride + 1, size).alias("words"))


def commit_chunks(current: DataFrame, incoming: DataFrame, owner: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new table, (owner, removed, added)): the incoming rows replace everything their owners had."""
    owners = incoming.select(owner).distinct()
    kept = current.join(owners, owner, "left_anti")
    gone = current.join(owners, owner, "left_semi").join(incoming, key, "left_anti").groupBy(owner).agg(F.count(F.lit(1)).alias("removed"))
    new = incoming.join(current, key, "left_anti").groupBy(owner).agg(F.count(F.lit(1)).alias("added"))
    counts = owners.join(gone, owner, "left").join(new, owner, "left").select(owner, F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("added", F.lit(0)).alias("added"))
    return kept.unionByName(incoming), counts


def commit_figures(current: DataFrame, incoming: DataFrame, pages: DataFrame, owner: str, page: str) -> DataFrame:
    """The figures after a commit: an owner's old ones go where the incoming ones cover all its pages (owner, page); a
    partial set is refused and changes nothing."""
    of = pages.select(owner, page).distinct().groupBy(owner).agg(F.count(F.lit(1)).alias("_of"))
    have = incoming.select(owner, page).distinct().join(pages.select(owner, page).distinct(), [owner, page], "left_semi").groupBy(owner).agg(F.count(F.lit(1)).alias("_n"))
    whole = of.join(have, owner).filter("_n = _of").select(owner)
    return current.join(whole, owner, "left_anti").unionByName(incoming.join(whole, owner, "left_semi"))


def reshelve(files: DataFrame, root: str) -> DataFrame:
    """``doc, shelf`` of the documents that only ``root`` holds (doc, root, path): the first folder of their first path."""
    from ..functions.text import shelf

    here = files.filter(F.col("root") == root).join(files.filter(F.col("root") != root).select("doc").distinct(), "doc", "left_anti")
    return here.groupBy("doc").agg(F.min("path").alias("path")).select("doc", shelf(F.col("path"), F.lit(root)).alias("shelf"))


def draw_pages(pages: DataFrame, group: str, page: str, seed: str, draws: int) -> DataFrame:
    """At most ``draws`` pages of each group in a seeded order, with the number of the draw from 1."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(page).cast("string"))), page)
    return pages.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= draws)


def ring(log: DataFrame, new: DataFrame, newest_first: list, size: int) -> DataFrame:
    """A log after an append: its ``size`` newest rows, numbered from 1."""
    kept = log.unionByName(new).orderBy(*newest_first).limit(size)
    return kept.withColumn("nth", F.row_number().over(Window.orderBy(*newest_first)))


def reconcile(known: DataFrame, found: DataFrame | None) -> DataFrame:
    """What happened to files: (path, change, old_path).

    ``known`` has path, inode, size, mtime, state ('present' or 'missing');
    ``found`` path, inode, size, mtime. A path in both is returned, edited or
    unchanged (no row); else a unique inode whose old path vanished has moved;
    else it was added; what is left is missing. No listing (None) is no news.
    """
    if found is None:
        return known.select("path", F.lit("declined").alias("change"), F.lit(None).cast("string").alias("old_path")).limit(0)
    k = known.select("path", F.col("inode").alias("ki"), F.col("size").alias("ks"), F.col("mtime").alias("km"), "state")
    both = k.join(found.withColumn("here", F.lit(True)), "path", "full_outer")
    matched = both.filter("state is not null and here")
    change = F.when(F.col("state") == "missing", "returned").when((F.col("ks") != F.col("size")) | (F.col("km") != F.col("mtime")), "edited")
    same = matched.select("path", change.alias("change"), F.lit(None).cast("string").alias("old_path")).filter("change is not null")
    gone = both.filter("here is null and state = 'present'").select(F.col("path").alias("old_path"), F.col("ki").alias("inode"))
    new = both.filter("state is null").select("path", "inode")
    once = lambda x: x.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("inode"))).filter("_n = 1").drop("_n")
    moved = once(new).join(once(gone), "inode").select("path", F.lit("moved").alias("change"), "old_path")
    added = new.join(moved, "path", "left_anti").select("path", F.lit("added").alias("change"), F.lit(None).cast("string").alias("old_path"))
    lost = gone.join(moved.select("old_path"), "old_path", "left_anti").select(F.col("old_path").alias("path"), F.lit("missing").alias("change"), F.lit(None).cast("string").alias("old_path"))
    return same.unionByName(moved).unionByName(added).unionByName(lost)


def guard_mass_deletion(changes: DataFrame, live: int, least: int = 5, share: float = 0.2) -> DataFrame:
    """Drop 'missing' when more than ``share`` of at least ``least`` live files vanished at once."""
    lost = changes.filter("change = 'missing'").agg(F.count(F.lit(1)).alias("_lost"))
    bad = F.lit(live >= least) & (F.col("_lost") > share * live)
    return changes.crossJoin(F.broadcast(lost)).filter(~((F.col("change") == "missing") & bad)).drop("_lost")


def next_state(state: Column, claimed: Column, text: Column, figures: Column, removed: Column) -> Column:
    """``struct<state, outcome, resume>`` of one attempt to bring a document to 'ready'.

    ``text`` and ``figures`` say how the two halves went: 'done', 'locked' (the
    store was held, the records are staged), 'unprepared' or another error; null
    is an error. ``removed`` is the half during which a tombstone was seen, if any.
    Without a claim, or from 'ready' or 'deleted', nothing happens; from
    'text_ready' only figures are due. A tombstone counts once a half is prepared.
    ``resume`` is the half whose staged records the next attempt commits.
    """
    idle, due = F.coalesce(state.isin("ready", "deleted"), F.lit(False)), ~F.coalesce(state == "text_ready", F.lit(False))
    is_ = lambda c, v: F.coalesce(c == v, F.lit(False))
    half = lambda c, gone: F.when(is_(c, "unprepared"), "failed").when(gone, "cancelled").when(is_(c, "locked"), "staged").when(~is_(c, "done"), "failed")
    first = F.when(due, half(text, is_(removed, "text")))
    ran = F.coalesce(first, half(figures, F.coalesce(removed.isin("text", "figures"), F.lit(False))), F.lit("ready"))
    outcome = F.when(~claimed, "skipped").when(idle, "ready").otherwise(ran)
    after = F.when(~claimed | idle, state).when(ran == "cancelled", "deleted").when(ran != "staged", ran).when(first.isNotNull(), "staged").otherwise("text_ready")
    return F.struct(after.alias("state"), outcome.alias("outcome"), F.when(outcome == "staged", F.when(first.isNotNull(), "text").otherwise("figures")).alias("resume"))


def running_before(frame: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``frame`` and, under ``name``, the sum of ``value`` over all rows before each in ``order``, which must be total.

    Rows are dealt by ranges of the order and written once, so that both passes see the same ranges.
    """
    dealt = keep(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))  # one row a partition
    ranges = ranges.select("_range", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("_range"))), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("_range").orderBy(*order))), F.lit(0))
    return dealt.withColumn("_within", within).join(F.broadcast(ranges), "_range").withColumn(name, F.col("_start") + F.col("_within")).drop("_range", "_start", "_within")


def evictions(pages: DataFrame, budget: int) -> DataFrame:
    """Page caches to drop (doc, bytes, kind, last_read): dead ones, then live ones least recently read first,
    larger first, until at most 0.9 of the budget is held; pinned ones never. A budget of 0 has no limit.

    The running sum is one of ranges and one within each range, so no task sees all documents.
    """
    dead = pages.filter("kind = 'dead'").select("doc", "bytes", "kind")
    if not budget:
        return dead
    held = pages.filter("kind <> 'dead'").agg(F.sum("bytes").alias("_held"))
    live = running_before(pages.filter("kind = 'live'"), ["last_read", F.desc("bytes"), "doc"], "bytes", "_before").crossJoin(F.broadcast(held))
    return dead.unionByName(live.filter(F.col("_held") - F.col("_before") > 0.9 * budget).select("doc", "bytes", "kind"))


def gap_bands(spans: DataFrame, key: list[str], join: float = 0.012, least: float = 0.07, top: float = 0.04, bottom: float = 0.96) -> DataFrame:
    """Empty bands of a page between merged vertical spans (y0, y1) of its words: key, y0, y1."""
    w = Window.partitionBy(*key).orderBy("y0", "y1")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    edges = spans.select(*key, "y0", "y1").unionByName(spans.select(*key).distinct().withColumn("y0", F.lit(bottom)).withColumn("y1", F.lit(bottom)))
    gaps = edges.withColumn("_from", F.greatest(F.coalesce(reach, F.lit(top)), F.lit(top))).withColumn("_to", F.least("y0", F.lit(bottom)))
    return gaps.filter((F.col("_to") - F.col("_from") >= least) & (F.col("_to") - F.col("_from") > join)).select(*key, F.col("_from").alias("y0"), F.col("_to").alias("y1"))


def fuse_hyphens(words: DataFrame, vocabulary: DataFrame, key: list[str]) -> DataFrame:
    """Words (key, pos, word) with those broken at a hyphen put together: fused where the vocabulary (term) has it, else
    with the hyphen. A double hyphen, or a next word that isn't lower case, is no break."""
    near = Window.partitionBy(*key).orderBy("pos")
    w = words.withColumn("_next", F.lead("word").over(near)).withColumn("_prev", F.lag("word").over(near))
    broken = lambda a, b: F.regexp_like(a, F.lit("[^-]-$")) & F.regexp_like(b, F.lit("^\\p{Ll}"))
    w = w.filter(~F.coalesce(broken(F.col("_prev"), F.col("word")), F.lit(False)))
    head = F.expr("substr(word, 1, length(word) - 1)")
    w = w.withColumn("_fused", F.when(broken(F.col("word"), F.col("_next")), F.concat(head, "_next")))
    known = vocabulary.select(F.col("term").alias("_fused"), F.lit(True).alias("_known")).distinct()
    w = w.join(known, "_fused", "left")
    whole = F.when(F.col("_known"), F.col("_fused")).when(F.col("_fused").isNotNull(), F.concat("word", "_next")).otherwise(F.col("word"))
    return w.select(*key, "pos", whole.alias("word"))


def overlap(a: str, b: str) -> Column:
    """Common area of two boxes with columns x, y, w, h under prefixes ``a`` and ``b``."""
    side = lambda p, n: F.greatest(F.least(F.col(a + p) + F.col(a + n), F.col(b + p) + F.col(b + n)) - F.greatest(F.col(a + p), F.col(b + p)), F.lit(0.0))
    return side("x", "w") * side("y", "h")


def keep_regions(model: DataFrame, heuristic: DataFrame, key: list[str], score: float = 0.35, area: float = 0.01, most: float = 0.3) -> DataFrame:
    """Model figures that score and are large enough, and heuristic ones (id, box) that overlap none of them by much."""
    good = model.filter((F.col("score") >= score) & F.col("cls").isin("picture", "table", "formula") & (F.col("w") * F.col("h") >= area))
    m = good.select(*key, *(F.col(c).alias("m" + c) for c in "xywh"))
    h = heuristic.select(*key, "id", *(F.col(c).alias("h" + c) for c in "xywh"))
    clash = h.join(m, key).filter(overlap("h", "m") > most * F.col("hw") * F.col("hh")).select(*key, "id").distinct()
    return good.select(*key, "id", *"xywh").unionByName(heuristic.select(*key, "id", *"xywh").join(clash, [*key, "id"], "left_anti"))


def audit(pages: DataFrame, doc: str, noisy: float = 0.45, least_bytes: int = 40, worst: int = 3) -> DataFrame:
    """Legibility per document (page, bytes, score, min_score): pages, mean, upper median, noisy share, worst pages."""
    p = pages.filter(F.col("bytes") >= least_bytes)
    w = Window.partitionBy(doc).orderBy("score", "page")
    p = p.withColumn("_n", F.row_number().over(w)).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(doc)))
    low = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= worst, F.col("page")))), ",")
    return p.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.avg("score").alias("mean"), F.max(F.when(F.col("_n") == F.expr("_of div 2 + 1"), F.col("score"))).alias("median"), F.avg(F.when(F.col("min_score") < noisy, 1.0).otherwise(0.0)).alias("noisy"), low.alias("worst"))
