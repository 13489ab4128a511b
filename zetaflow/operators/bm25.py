"""Full-text search: postings, BM25 scores, filters, expansion of terms, pseudo-relevance feedback.

The index is two tables, postings (term, doc, tf) and lengths (doc, dl), plus one
row of statistics. Queries are a table too, so a batch is one join; only query
terms, whose number is checked, are ever broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import default_tokens

K1, B = 1.2, 0.75
#: Query terms up to this many are broadcast to the postings; beyond it the join shuffles.
BROADCAST_TERMS = 10_000


@dataclass
class Index:
    """Postings (term, doc, tf, dl: the document's length) and one row of statistics (n, avgdl).

    Built from texts it is a plan: ``asked`` gives the postings of some terms only,
    and other terms are dropped before anything is counted. :func:`save` makes it a
    stored index, read back by :func:`open_index`.
    """

    words: DataFrame | None
    stats: DataFrame
    stored: DataFrame | None = None
    stored_lengths: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return self.stored if self.stored is not None else _postings(self._tokens().filter("term is not null"))

    @property
    def lengths(self) -> DataFrame:
        return self.stored_lengths if self.stored_lengths is not None else self.words.select("doc", "dl")

    def asked(self, terms: DataFrame) -> DataFrame:
        """Postings of the given (few, distinct) terms."""
        if self.stored is not None:
            shard = F.expr(f"cast(pmod(xxhash64(term), {SHARDS}) as int)")
            some = [r["s"] for r in terms.select(shard.alias("s")).distinct().collect()]  # at most SHARDS numbers
            return self.stored.filter(F.col("shard").isin(*some)).drop("shard").join(F.broadcast(terms), "term")
        return _postings(self._tokens().join(F.broadcast(terms), "term"))

    def _tokens(self) -> DataFrame:
        # an inner explode would put a filter on the array's size below, and split every text twice
        return self.words.select("doc", "dl", F.explode_outer("ts").alias("term"))

    def doc_count(self) -> DataFrame:
        return self.stats.select("n")


#: Folders that a stored index keeps its postings in, by the hash of the term; a query reads only its terms' folders.
SHARDS = 64


def _postings(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[Column], Column] = default_tokens) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.explode_outer(tokenizer(F.col(text_col))).alias("term")).filter("term is not null")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[Column], Column] = default_tokens) -> Index:
    """Index the current rows: replacing a document is indexing its new row."""
    words = docs.select(F.col(id_col).alias("doc"), tokenizer(F.col(text_col)).alias("ts")).select("doc", "ts", F.greatest(F.size("ts"), F.lit(0)).cast("long").alias("dl"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    return Index(words, stats)


def save(index: Index, root: str) -> None:
    """Store postings by shards of terms, sorted by term within, with lengths and statistics."""
    shard = F.expr(f"cast(pmod(xxhash64(term), {SHARDS}) as int)")
    rows = index.postings.withColumn("shard", shard)
    rows.repartition("shard", F.expr("pmod(xxhash64(doc), 4)")).sortWithinPartitions("shard", "term", "doc").write.mode("overwrite").partitionBy("shard").parquet(f"{root}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{root}/lengths")
    index.stats.write.mode("overwrite").parquet(f"{root}/stats")


def open_index(spark, root: str) -> Index:
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    return Index(None, read("stats"), read("postings"), read("lengths"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def scores(index: Index, queries: DataFrame, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``qid, doc, score`` for every document that matches. ``queries`` has (qid, term); repeated terms count once.

    ``allowed`` (doc) restricts what is scored; document frequencies and lengths
    stay those of the whole corpus.
    """
    asked = queries.select("qid", "term").distinct()
    terms = asked.select("term").distinct()
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        hit = index.asked(terms)
        df = F.broadcast(hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    else:
        hit = index.postings.join(terms, "term")
        df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    if allowed is not None:
        scored = hit.join(allowed, "doc", "left_semi")
    else:
        scored = hit
    scored = scored.join(df, "term").crossJoin(F.broadcast(index.stats))
    scored = scored.withColumn("w", idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b))
    return scored.join(F.broadcast(asked) if few else asked, "term").groupBy("qid", "doc").agg(F.sum("w").alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents of each query with their rank from 0; ties to the smaller document."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def feedback_terms(index: Index, ranked: DataFrame, queries: DataFrame, docs: int, terms: int) -> DataFrame:
    """Pseudo-relevance feedback: the heaviest tf-idf terms of each query's first documents, without its own."""
    top = ranked.filter(F.col("rank") < docs).select("qid", "doc")
    df = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = index.postings.join(top, "doc").join(df, "term").crossJoin(F.broadcast(index.stats))
    found = found.groupBy("qid", "term").agg(F.sum(F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 1.0))).alias("weight"))
    found = found.join(queries.select("qid", "term"), ["qid", "term"], "left_anti")
    w = Window.partitionBy("qid").orderBy(F.desc("weight"), "term")
    return found.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= terms)


# Term dictionary.


def term_dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[Column], Column] = default_tokens) -> DataFrame:
    return tokens(docs, id_col, text_col, tokenizer).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def complete(terms: DataFrame, prefix: str, k: int) -> DataFrame:
    """The first ``k`` terms with a prefix."""
    return terms.filter(F.startswith("term", F.lit(prefix))).orderBy("term").limit(k)


def complete_ranked(terms: DataFrame, prefix: str, k: int, scan: int = 2000) -> DataFrame:
    """The ``k`` most frequent among the first ``scan`` terms with a prefix."""
    return complete(terms, prefix, scan).orderBy(F.desc("freq"), "term").limit(k)


def correct(terms: DataFrame, token: str, k: int, scan: int = 4000, most: int = 2) -> DataFrame:
    """Near spellings that share the first two characters: by distance, frequency, term."""
    near = complete(terms, token[:2], scan).filter(F.col("term") != token).withColumn("d", F.levenshtein("term", F.lit(token)))
    return near.filter(F.col("d") <= most).orderBy("d", F.desc("freq"), "term").limit(k)


def prefix_matches(terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``terms`` (term, ...) that begin with one of ``prefixes`` (prefix): an equi-join on the lengths that are asked."""
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]  # word lengths: a short list
    cuts = F.array_distinct(F.array(*(F.left("term", F.lit(n)) for n in lengths))) if lengths else F.array().cast("array<string>")
    return terms.withColumn("prefix", F.explode(cuts)).join(prefixes, "prefix")


def coverage(index: Index, queries: DataFrame) -> DataFrame:
    """``qid, doc, coverage``: the share of a query's terms (qid, term) that begin some word of a document that has one."""
    asked = queries.select("qid", F.col("term").alias("prefix")).distinct()
    sizes = asked.groupBy("qid").agg(F.count(F.lit(1)).alias("of"))
    words = index.postings.select("term", "doc")
    begun = prefix_matches(words.select("term").distinct(), asked.select("prefix").distinct())
    hit = words.join(begun, "term").select("prefix", "doc").distinct()
    return hit.join(asked, "prefix").groupBy("qid", "doc").agg(F.count(F.lit(1)).alias("n")).join(sizes, "qid").select("qid", "doc", (F.col("n") / F.col("of")).alias("coverage"))


def expand(terms: DataFrame, words: list[str], prefix: int = 5, fuzzy: int = 3) -> DataFrame:
    """Query terms: the words, completions of the last one, and near spellings of unknown ones. Columns term, why."""
    spark = terms.sparkSession
    own = spark.createDataFrame([(w, 0) for w in dict.fromkeys(words)], "term string, why int")
    parts = [own, complete(terms, words[-1], prefix).select("term", F.lit(1).alias("why"))]
    for w in dict.fromkeys(words):
        known = terms.filter(F.col("term") == w).select(F.lit(1).alias("known")).limit(1)
        parts.append(correct(terms, w, fuzzy).join(F.broadcast(known), F.lit(True), "left_anti").select("term", F.lit(2).alias("why")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("term").agg(F.min("why").alias("why"))
