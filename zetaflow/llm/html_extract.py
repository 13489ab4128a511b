"""Main text of web pages by a conditional random field over DOM leaf blocks."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .html_blocks import blocks, features
from .html_crf import Crf, train
from .html_pages import labelled_page

#: Labelled pages the field is trained on.
TRAIN_PAGES = 600


def page_features(page: str) -> tuple[list[str], list[list[str]]]:
    found = blocks(page)
    return [b.text for b in found], [features(b, i, len(found)) for i, b in enumerate(found)]


@functools.cache
def default_model(pages: int = TRAIN_PAGES) -> Crf:
    rows = []
    for seed in range(pages):
        page, labels = labelled_page(seed)
        got = page_features(page)[1]
        if len(got) != len(labels):
            raise ValueError(f"training page {seed} has {len(got)} blocks and {len(labels)} labels")
        rows.append((got, labels))
    return train(rows)


def main_text(page: str, model: Crf) -> str:
    texts, feats = page_features(page)
    return " ".join(t for t, label in zip(texts, model.decode(feats), strict=True) if label)


def extract(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``.

    Defined cases: a null or empty page, and one without an article, give the
    empty text; broken markup is read as far as it goes: only an open comment,
    script or style swallows the rest, as in browsers; null identifiers and urls are passed on; repeated
    rows each give a row; whole pages of any length are read; an empty table
    gives an empty result; other columns are ignored.
    """
    model = model or default_model()

    def run(batches):
        for batch in batches:
            texts = [main_text(batch.column(2)[i].as_py() or "", model) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["a", "b", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("a"), F.col(url_col).alias("b"), F.col(html_col).cast("string").alias("c"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, text string, n_chars long")
    return out.select(F.col("a").alias(id_col), F.col("b").alias(url_col), "text", "n_chars")


def op6_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
