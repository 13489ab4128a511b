"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees boosted in a cycle over the features (then over the chosen pairs)
are summed into lookup tables, one per feature and pair. A score is the logistic
of the sum of the cells that a text's binned features fall in.

Learning reads at most ``max_fit_rows`` labelled rows, those with the smallest
hashes; scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import table, tidy

MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
SEED = 11
#: Least sum of second derivatives in a leaf.
LEAST_LEAF = 0.1

# Frequent function words of four languages.
_STOP = frozenset("the of and to in a is that it for on was be are as with by this or an from at have not und der die das den von zu mit ist ein eine im auf für des dem nicht et le la les de des en un une du est que dans pour sur au par qui el los las y es por con una se del al lo como su".split())

FEATURES = ("log_words", "word_len", "word_len_sd", "stop_share", "distinct_words", "top_word", "upper", "digits", "end_marks", "shouts", "bars", "symbols", "braces", "other_ascii", "accents", "short_words", "long_words", "log_lines", "words_per_line", "repeated_lines", "long_run", "distinct_pairs")

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"|", b"#$%&*@^~+=_\\", b"(){}[]<>/", b"\"'`-"), start=1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9


def features(text: str) -> np.ndarray:
    """Statistics of a whole text; all zero for an empty one."""
    out = np.zeros(len(FEATURES))
    words = text.split()
    n = len(words)
    if not n:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASS[raw], minlength=10)[1:] / len(raw)
    lens = np.fromiter(map(len, words), np.int64, n)
    kinds = Counter(words)
    stop = sum(kinds[w] for w in _STOP if w in kinds)
    lines = [x for x in text.split("\n") if x]
    same = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1], True])
    out[:] = (np.log1p(n), lens.mean(), lens.std(), stop / n, len(kinds) / n, max(kinds.values()) / n, *share[:9], (lens <= 2).mean(), (lens >= 15).mean(), np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log(np.diff(same).max()), len(set(pairwise(words))) / max(1, n - 1))
    return out


@dataclasses.dataclass
class Model:
    cuts: list[np.ndarray]
    base: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.single):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over ordered bins, as a value per bin."""
    bounds, k = [(0, len(grad))], len(grad)
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]
    while len(bounds) < leaves:
        best = (1e-9, None)
        for at, (lo, hi) in enumerate(bounds):
            if hi - lo < 2:
                continue
            mid = np.arange(lo + 1, hi)
            gl, hl = g[mid] - g[lo], h[mid] - h[lo]
            gr, hr = g[hi] - g[mid], h[hi] - h[mid]
            gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - (gl + gr) ** 2 / (hl + hr + lam)
            gain[(hl < LEAST_LEAF) | (hr < LEAST_LEAF)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (at, int(mid[i])))
        if best[1] is None:
            break
        at, mid = best[1]
        lo, hi = bounds.pop(at)
        bounds += [(lo, mid), (mid, hi)]
    out = np.zeros(k)
    for lo, hi in bounds:
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + lam)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 30, n_bins: int = 48, n_pairs: int = 6, rate: float = 0.2, lam: float = 1.0) -> Model:
    """Cyclic boosting: one tree per feature and round on the logistic gradient, then trees over pairs of features."""
    d = len(FEATURES) if x.ndim < 2 or not len(x) else x.shape[1]
    if not len(x) or y.min() == y.max():
        rate_one = 0.5 if not len(x) else float(y.mean())
        z = np.log((rate_one * len(x) + 1) / ((1 - rate_one) * len(x) + 1))
        return Model([np.array([])] * d, float(z), [np.zeros(1)] * d, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(d)]
    model = Model(cuts, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [np.zeros(len(c) + 1) for c in cuts], [])
    b = model.bins(x)
    z = np.full(len(x), model.base)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-z))
            size = len(model.single[j])
            step = rate * _tree(np.bincount(b[:, j], y - p, size), np.bincount(b[:, j], p * (1 - p), size), 3, lam)
            model.single[j] += step
            z += step[b[:, j]]
    p = 1 / (1 + np.exp(-z))
    gains = []
    for i in range(d):
        for j in range(i):
            qi, qj = b[:, i] * 6 // len(model.single[i]), b[:, j] * 6 // len(model.single[j])
            g, h = np.bincount(qi * 6 + qj, y - p, 36), np.bincount(qi * 6 + qj, p * (1 - p), 36)
            gains.append((float((g**2 / (h + 10)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, np.zeros((len(model.single[i]), len(model.single[j])))))
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            p = 1 / (1 + np.exp(-z))
            g = np.zeros(t.shape)
            h = np.zeros(t.shape)
            np.add.at(g, (b[:, i], b[:, j]), y - p)
            np.add.at(h, (b[:, i], b[:, j]), p * (1 - p))
            step = np.zeros(t.shape)  # depth two: one cut of the first feature, then one of the second on either side
            outer = _tree(g.sum(1), h.sum(1), 2, lam)
            cut = int(np.argmax(outer != outer[0])) if (outer != outer[0]).any() else len(outer)
            for lo, hi in ((0, cut), (cut, len(outer))):
                if lo < hi:
                    step[lo:hi] = _tree(g[lo:hi].sum(0), h[lo:hi].sum(0), 2, lam)
            t += rate * step
            z += rate * step[b[:, i], b[:, j]]
    return model


def _feature_rows(batches):
    for batch in batches:
        texts = batch.column(1)
        x = [features(texts[i].as_py() or "").tolist() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_fit_rows: int = MAX_FIT_ROWS, seed: int = SEED) -> Model:
    """Fit on the training fold: rows whose crc32(identifier as text) mod 5 is not 0."""
    sample = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null and crc32(cast(id as string)) % 5 != 0")
    sample = sample.orderBy(F.xxhash64(F.lit(seed), "id"), "id", "y").limit(max_fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(sample), "id")
    got = rows.select("y", "t").mapInArrow(tidy(_feature_rows), "y int, x array<double>").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums shouldn't depend on it
    return fit(x[order], y[order])


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names) and ``score``, by one pass over the texts.

    A text that is a string already goes to Python within its row only.
    """
    at = next((i for i, f in enumerate(docs.schema) if f.name == text_col and isinstance(f.dataType, StringType)), None)

    def run(batches):
        for batch in batches:
            texts = batch.column(1) if at is None else batch.column(0).field(at)
            x = np.array([features(texts[i].as_py() or "") for i in range(batch.num_rows)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["row", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), *([F.col(text_col).cast("string").alias("text")] if at is None else []))
    return rows.mapInArrow(tidy(run), StructType([rows.schema["row"], StructField("score", DoubleType())]))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score column; one of that name is replaced."""
    return _scored(docs, model, text_col).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != name), F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, **more) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``.

    Defined cases: a null text is scored as an empty one; a null identifier is
    not held out and has no label; repeated rows get the same score; an empty
    table gives an empty result; with no labels every score is 0.5; other columns
    are ignored and never enter a score.
    """
    model = train(docs, labels, text_col, id_col, **more)
    out = score_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), model, "t").drop("t")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, **more) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that score at least ``threshold``."""
    model = train(docs, labels, text_col, **more)
    return _scored(docs, model, text_col).filter(F.col("score") >= threshold).select("row.*")


def op2_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
