"""Exact deduplication by skew-safe combining.

Copies are merged in three steps, each of which groups by the full content and
not by its digest alone: within an Arrow batch, within (digest, salt) groups,
and among the salts' winners. However many copies a text has, one task sees at
most one row per batch and then one row per salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, unused

SALTS = 16


def sha256_hex(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _normalised(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    text = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
    return batch.column(0), text.cast(pa.large_string())


def _digests(text: pa.Array, digest: Callable[[bytes], str]) -> pa.Array:
    return pa.array([digest(t.as_buffer().to_pybytes()) for t in text], pa.string())


def _local(digest: Callable[[bytes], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, text = _normalised(batch)
            got = pa.table({"id": ids, "norm": text}).group_by("norm").aggregate([("id", "max"), ([], "count_all")])
            norm = got["norm"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [_digests(norm, digest), norm.cast(pa.string()), got["id_max"].combine_chunks(), got["count_all"].combine_chunks()],
                names=["sha", "norm", "keep_id", "n"],
            )

    return run


def _tag(digest: Callable[[bytes], str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = _normalised(batch)
            cols = [ids, _digests(text, digest)] + ([text.cast(pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "sha", "norm"][: len(cols)])

    return run


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[bytes], str] = sha256_hex) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty. The largest id stays. A null id loses to any other; in a group of
    null ids keep_id is null and each row is marked kept. Rows that repeat the
    kept id are all marked kept; `deduplicate` keeps one of them. Other columns
    of `docs` are ignored; an empty table gives an empty result. If two
    contents share a digest, rows are matched by content as well.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    local = rows.mapInArrow(_local(digest), "sha string, norm string, keep_id long, n long")
    salted = (
        local.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("sha", "salt", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    )
    winners = salted.groupBy("sha", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    found = checkpointed(winners.select("sha", "keep_id", "group_size"))
    if found.groupBy("sha").count().filter("count > 1").isEmpty():
        tagged, on = rows.mapInArrow(_tag(digest, False), "doc_id long, sha string"), ["sha"]
    else:
        tagged, on, found = rows.mapInArrow(_tag(digest, True), "doc_id long, sha string, norm string"), ["sha", "norm"], winners
    return tagged.join(found, on).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one per distinct text, with all their
    columns. Among rows that repeat the kept id the choice is arbitrary but the
    rows' texts are equal. The rows are dealt once, by id and digest together,
    so that neither a hot text nor the choice among repeats deals them again."""
    mark, key, n = (unused(c, docs) for c in ("exact_mark", "exact_key", "exact_n"))

    def named(doc_id: Column, sha: Column) -> Column:
        return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), sha)

    kept = copy_groups(docs, id_col, text_col).filter("kept").select(named(F.col("doc_id"), F.col("text_sha256")).alias(mark)).distinct()
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    unique = docs.withColumn(key, named(F.col(id_col).cast("long"), F.sha2(lower, 256))).join(kept, F.col(key) == F.col(mark))
    first = Window.partitionBy(key).orderBy(F.lit(1))
    return unique.withColumn(n, F.row_number().over(first)).filter(F.col(n) == 1).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
