"""Hybrid search from words and vectors to a page of hits, for a whole table of queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.state import keep
from . import bm25, fusion, knn

# Depths of the lists, expansions of a word, sizes of the reranked pools.
LEXICAL_DEPTH, SEMANTIC_DEPTH = 512, 40
COMPLETIONS, CORRECTIONS = 5, 3
RERANKED, DIVERSIFIED = 30, 100


@dataclass(frozen=True)
class Mode:
    """What a search does beyond matching words; the last word is completed in every mode."""

    semantic: bool = False
    fuzzy: bool = False
    diversify: bool = False


FULL, INSTANT = Mode(True, True, True), Mode()


def expand(terms: DataFrame, words: DataFrame, fuzzy: bool) -> DataFrame:
    """``qid, term``: a query's words (qid, pos, term), completions of its last one, near spellings of those the
    dictionary (term, freq) lacks."""
    last = words.groupBy("qid").agg(F.max_by("term", "pos").alias("prefix"))
    nth = Window.partitionBy("prefix").orderBy("term")
    begun = bm25.prefix_matches(terms.select("term"), last.select("prefix").distinct()).withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= COMPLETIONS)
    out = words.select("qid", "term").unionByName(last.join(begun, "prefix").select("qid", "term"))
    if fuzzy:
        unknown = words.select("term").distinct().join(terms.select("term"), "term", "left_anti").select(F.col("term").alias("word"))
        size = F.length("word")  # a spelling within two edits is at most two characters shorter or longer
        unknown = unknown.select("word", F.left("word", F.lit(2)).alias("start"), F.explode(F.sequence(size - 2, size + 2)).alias("size"))
        sized = terms.withColumn("start", F.left("term", F.lit(2))).withColumn("size", F.length("term"))
        near = sized.join(unknown, ["start", "size"]).withColumn("d", F.levenshtein("term", "word", 2)).filter("d >= 0")
        best = Window.partitionBy("word").orderBy("d", F.desc("freq"), "term")
        near = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= CORRECTIONS).select(F.col("word").alias("term"), F.col("term").alias("spelling"))
        out = out.unionByName(words.select("qid", "term").join(near, "term").select("qid", F.col("spelling").alias("term")))
    return out.distinct()


def scope(docs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``qid, doc`` of queries that are restricted, ``qid`` of those that are not).

    ``asked`` has (qid, doc, collection): a document overrides a collection, and a
    collection that no document (doc, collection) is in restricts nothing.
    """
    by_doc = asked.filter("doc is not null").select("qid", "doc").join(docs.select("doc"), "doc", "left_semi")
    known = docs.select("collection").distinct()
    rest = asked.filter("doc is null")
    by_name = rest.select("qid", "collection").join(docs, "collection").select("qid", "doc")
    return by_doc.unionByName(by_name), rest.join(known, "collection", "left_anti").select("qid")


def search(
    index: bm25.Index,
    terms: DataFrame,
    words: DataFrame,
    k: int,
    mode: Mode = INSTANT,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    allowed: DataFrame | None = None,
    reserved: DataFrame | None = None,
    late: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    offset: int = 0,
) -> DataFrame:
    """``qid, doc, fused, rank`` (from ``offset``) of one page of ``k`` hits per query.

    ``words`` (qid, pos, term) are the queries, ``terms`` (term, freq) the
    dictionary; ``vectors`` (id, v) and ``query_vectors`` (qid, q) serve the
    semantic list; ``allowed`` (doc) restricts both lists; documents in
    ``reserved`` (doc) are boosted; ``late`` is (words of documents, vectors of
    words, tokens of queries) as :func:`fusion.max_sim` takes them. A query
    without words, or whose words match nothing, has no lexical hits.

    Scores are rounded to six decimals before they are ranked, so that equal ones
    tie whatever order they were added up in.
    """
    six = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    lexical = bm25.scores(index, expand(terms, words, mode.fuzzy), allowed).withColumn("score", six("score"))
    whole, lifted = lexical, []
    semantic = None
    if mode.semantic and vectors is not None and query_vectors is not None:
        ids = None if allowed is None else allowed.select(F.col("doc").alias("id"))
        semantic = keep(knn.nearest(vectors, query_vectors, SEMANTIC_DEPTH, allowed=ids).select("qid", "id", "dist"))
        lifted.append((semantic.select("qid", F.col("id").alias("doc")), ["qid", "doc"]))
    if reserved is not None:
        lifted.append((reserved.select("doc"), ["doc"]))
    if lifted:
        whole = keep(whole)  # read for the first hits, and for those that another list has
    lexical = bm25.best(whole, max(offset + k, LEXICAL_DEPTH)).select("qid", "doc", "score")
    for other, key in lifted:
        lexical = lexical.unionByName(whole.join(other, key, "left_semi").select("qid", "doc", "score"))
    lexical = lexical.distinct() if lifted else lexical
    if semantic is None:
        semantic = lexical.select("qid", F.col("doc").alias("id"), F.lit(0.0).alias("dist")).limit(0)
    hits = fusion.cutoff(fusion.fuse(lexical, semantic, reserved=reserved)).withColumn("fused", six("fused"))
    hits = fusion.ranked(hits).select("qid", "doc", "fused", "rank")
    if late is not None or mode.diversify:
        hits = keep(hits)  # every reranking step reads the list several times
    if late is not None:
        head = fusion.max_sim(hits.filter(F.col("rank") < RERANKED), *late).select("qid", "doc", F.col("reranked").alias("new"))
        hits = hits.join(head, ["qid", "doc"], "left")
        order = Window.partitionBy("qid").orderBy(F.col("new").isNull(), F.desc("new"), "rank")
        hits = hits.withColumn("at", F.row_number().over(order) - 1).select("qid", "doc", F.coalesce("new", "fused").alias("fused"), F.col("at").alias("rank"))
        hits = keep(hits) if mode.diversify else hits
    if mode.diversify and vectors is not None:
        pool = hits.filter(F.col("rank") < DIVERSIFIED).join(vectors.select(F.col("id").alias("doc"), F.col("v").cast("array<double>").alias("v")), "doc", "left")
        pool = pool.withColumn("v", F.coalesce("v", F.array().cast("array<double>")))
        spread = fusion.mmr(pool.select("qid", "doc", "fused", "v"), depth=DIVERSIFIED)
        hits = hits.join(spread, ["qid", "doc"], "left").withColumn("rank", F.coalesce("mmr_rank", "rank")).drop("mmr_rank")
    return fusion.page(hits, offset, k).select("qid", "doc", "fused", F.col("rank").cast("long").alias("rank"))
