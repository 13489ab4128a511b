"""Secret scans with an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its content. The
ledger holds one row per (blob, rule version) that was ever scanned, with its
findings. A scan reads only blobs that the ledger lacks for the current rules,
appends them, and joins findings back to all rows that hold the blob.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

#: Raise it whenever a rule changes: all blobs are then unseen.
RULE_VERSION = 1

# The three base rules and the shapes of well-known credentials.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MORE = (
    ("pem", "PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("github", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("google", "AIza", re.compile(r"\bAIza[0-9A-Za-z_-]{35}")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in _MORE))
_HINTS = ("passw", "secret", "token", "api")

LEDGER_SCHEMA = "blob string, rule_version int, n_assign long, n_access long, n_hex long, base string, spans string"


def find(text: str) -> tuple[list, list]:
    """(base spans, all spans) of one text: (start, rank of kind, end), sorted. Positions are code points, ends exclusive."""
    base = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(h in low for h in _HINTS):
            base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    more = [(m.start(), 3 + i, m.end()) for i, (_, hint, rule) in enumerate(_MORE) if hint in text for m in rule.finditer(text)]
    return base, sorted(base + more) if more else base


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def _scan(rule_version: int):
    def run(batches):
        for batch in batches:
            blobs, texts = batch.column(0), batch.column(1)
            rows = []
            for i in range(batch.num_rows):
                base, spans = find(texts[i].as_py())
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((rule_version, *n, _joined(base), _joined(spans)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([blobs, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in LEDGER_SCHEMA.split(", ")])

    return run


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger with every blob of ``docs`` scanned under ``rule_version``; blobs it already holds aren't read again."""
    text = text_or_empty(text_col)
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("t"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    blobs = blobs.groupBy("blob").agg(F.first("t").alias("t"))  # one copy of each, combined before the shuffle
    new = materialize(blobs.mapInArrow(_scan(rule_version), LEDGER_SCHEMA))
    return new if ledger is None else ledger.unionByName(new)


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings per row, new ledger).

    Findings: ``doc_id, n_assign, n_access, n_hex, base_sha256, base, spans``;
    spans are ``kind:start:end``, comma-joined, by start and then kind.

    Defined cases: a null text is empty and has no finding; null identifiers and
    repeated rows each get their row; whole texts of any length are scanned; an
    empty table gives an empty result; other columns are ignored.
    """
    ledger = update_ledger(docs, ledger, text_col, rule_version)
    hits = ledger.filter((F.col("rule_version") == rule_version) & (F.col("spans") != "")).drop("rule_version")
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col), 256).alias("blob"))
    out = rows.join(hits, "blob", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    base = F.coalesce("base", F.lit(""))
    return out.select(F.col("id").alias(id_col), *zero, F.sha2(base, 256).alias("base_sha256"), base.alias("base"), F.coalesce("spans", F.lit("")).alias("spans")), ledger


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", path_col: str = "path", version_col: str = "version", rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger) of a history: one row per version of a path, all of them, not only the newest.

    Findings have a row per (path, version) whose content holds a secret:
    ``path, version, blob, spans, current`` (whether it is the newest version of
    its path) and ``paths`` (how many paths ever held that blob). A content is
    scanned once for a rule version, however many paths and versions hold it and
    in whichever call it came first.

    Defined cases: a null text is a deletion and has no finding; repeated rows
    count once; null paths and versions are values like others (null is the
    oldest version); an empty history gives an empty result; other columns are
    ignored.
    """
    rows = versions.select(F.col(path_col).alias("path"), F.col(version_col).alias("version"), F.col(text_col).cast("string").alias("t"))
    ledger = update_ledger(rows.filter("t is not null"), ledger, "t", rule_version)
    known = rows.select("path", "version", F.sha2("t", 256).alias("blob")).distinct()
    newest = known.groupBy("path").agg(F.max(F.struct(F.col("version").isNotNull().alias("is"), "version")).alias("newest"))
    known = known.join(newest.withColumnRenamed("path", "of"), F.col("path").eqNullSafe(F.col("of")))
    current = F.col("version").eqNullSafe(F.col("newest.version"))
    hits = ledger.filter((F.col("rule_version") == rule_version) & (F.col("spans") != "")).select("blob", "spans")
    found = known.join(hits, "blob").select("path", "version", "blob", "spans", current.alias("current"))
    holders = found.select("blob", "path").distinct().groupBy("blob").agg(F.count(F.lit(1)).alias("paths"))
    return found.join(holders, "blob").select("path", "version", "blob", "spans", "current", "paths"), ledger


def op4_secrets(spark, sf_dir):
    found, _ = scan_secrets(table(spark, sf_dir, "documents"))
    return found.drop("base")
