"""Secret scan with an incremental ledger of content-addressed blobs.

Every version of a text is known by the SHA-256 of its bytes. The ledger is a table of (blob, rules, findings): a scan
hashes all versions, takes the blobs that the ledger does not hold under the current version of the rules, reads each
of them once, appends what it found (also "nothing") and joins the findings back to every row that has the blob. Rows
that repeat a text cost a hash. A changed rule gets a new RULES name, so that everything is read again under it alone.

Null and empty texts are one blob without findings. Offsets are code points, end exclusive. Matches of different
rules may overlap; each is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.llm.words import slices

RULES = "1.1"

#: The formats that are looked for. Base kinds first.
ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
    r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Begin and end of a private key; an end belongs to the last begin before it, however far.
KEY_MARK = re.compile(r"-----(BEGIN|END) (?:[A-Z]+ ){0,3}PRIVATE KEY-----")
ADDED = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
#: A text without any of these strings holds no added kind.
_ADDED_HINTS = ("PRIVATE KEY-----", "_", "xox", "eyJ")
BASE = ("assign", "access", "hex")


def _private_keys(text: str) -> Iterator[tuple[int, int, str]]:
    begin = None
    for m in KEY_MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m.start()
        elif begin is not None:
            yield begin, m.end(), "private_key"
            begin = None


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything found, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(h in text for h in _ADDED_HINTS):
        found += [(m.start(), m.end(), kind) for kind, rule in ADDED.items() for m in rule.finditer(text)]
        found += _private_keys(text)
    order = {k: i for i, k in enumerate((*BASE, "private_key", *ADDED))}
    return sorted(found, key=lambda f: (f[0], order[f[2]]))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


FINDINGS = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        columns: list[list] = [[], [], [], [], []]
        for text in batch.column("text").to_pylist():
            found = find(text or "")
            base = [f for f in found if f[2] in BASE]
            for k, kind in enumerate(BASE):
                columns[k].append(sum(f[2] == kind for f in base))
            columns[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            columns[4].append(_joined(found))
        arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2)]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), *arrays], ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def blob_of(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules: str = RULES, id_column: str = "doc_id") -> DataFrame:
    """(blob, text) of every blob that the ledger lacks under these rules, once or, for repeated rows, a few times."""
    named = versions.select(F.col(id_column).alias("_id"), "text", blob_of(F.col("text")).alias("blob"))
    owners = named.groupBy("blob").agg(F.min("_id").alias("_owner"))
    if ledger is not None:
        owners = owners.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    owners = owners.withColumnRenamed("blob", "_blob").hint("shuffle_hash")
    mine = (F.col("blob") == F.col("_blob")) & F.col("_id").eqNullSafe(F.col("_owner"))
    return named.join(owners, mine, "left_semi").select("blob", "text")


def scan_increment(versions: DataFrame, path: str, rules: str = RULES, id_column: str = "doc_id") -> DataFrame:
    """Scan what is new in `versions` (id, text), extend the ledger at `path`, and return the findings of every row.

    path: a folder on storage that all executors share. A rerun after a failure adds only blobs that are missing.
    Result: the id and the columns of FINDINGS, one row for each input row; other columns play no part.
    """
    spark = versions.sparkSession
    try:
        ledger = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        ledger = None
    new = unseen_blobs(versions, ledger, rules, id_column).mapInArrow(_scanned, f"blob string, {FINDINGS}")
    new.withColumn("rules", F.lit(rules)).write.mode("append").parquet(path)
    ledger = spark.read.parquet(path).where(F.col("rules") == rules).drop("rules").dropDuplicates(["blob"])
    rows = versions.select(id_column, blob_of(F.col("text")).alias("blob"))
    return rows.join(ledger, "blob").drop("blob")
