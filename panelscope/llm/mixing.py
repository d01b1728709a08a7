"""Mixing sources to target weights by hash-threshold histograms.

Every document has a uniform 64-bit hash. A source takes all of its documents a
whole number of times, and once more those whose hash lies below a threshold.
The threshold is found without sorting: tokens are summed by source and hash
bucket, and only the bucket in which the budget runs out is split further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, unused, WORD

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
#: Bits by which a bucket is split in each round; they add up to 62.
ROUNDS = (14, 16, 16, 16)
#: More sources than this are refused: their sums are held by the driver.
MAX_SOURCES = 1_000_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = EPOCHS) -> dict[str | None, float]:
    """The budget of each source: `share` of all sizes dealt by weight, the
    weights repeating over sources by code point with null last. What exceeds
    `most` times a source's size is dealt again among the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def _plan(rows: DataFrame, spark: SparkSession, weights, share, most) -> tuple[DataFrame, dict]:
    sums = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["n"] for r in sums}
    want = targets(sizes, weights, share, most)
    plan = []
    for s, n in sizes.items():
        whole = min(int(want[s] // n), int(most)) if n else 0
        plan.append((s, n, want[s], whole, 0.0 if whole >= most else want[s] - whole * n))
    return spark.createDataFrame(plan, "source string, source_size long, target double, whole long, budget double"), sizes


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, times, taken: how often the mix takes
    each document. Its words are then `taken` = times x size.

    A null text has size 0, a null source is a source of its own. Each source's
    taken words differ from its target by at most half of the rows of the hash in
    which the budget ends: one document, or all rows that repeat both its id and
    text, which share a hash and are taken alike. An empty table gives an empty result; extra columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 2).alias("h"),
        )
    )
    plan, _ = _plan(rows, spark, weights, share, most)
    # low: hashes below it are taken, those from low + 2^rest on are not; the bucket between is refined.
    state = plan.withColumns({"low": F.lit(0).cast("long"), "left": F.col("budget"), "n": F.lit(0).cast("long")})
    rest = sum(ROUNDS)
    for bits in ROUNDS:
        rest -= bits
        inside = rows.join(F.broadcast(state.select(F.col("source").alias("s"), "low")), F.col("source").eqNullSafe(F.col("s"))).filter(F.shiftright(F.col("h"), rest + bits) == F.shiftright(F.col("low"), rest + bits))
        histogram = inside.groupBy("source", F.shiftright("h", rest).alias("bucket")).agg(F.sum("size").alias("n"))
        order = Window.partitionBy("source").orderBy("bucket")
        run = histogram.select("source", "bucket", "n", F.sum("n").over(order).alias("upto"))
        joined = run.join(F.broadcast(state.select(F.col("source").alias("s"), "left")), F.col("source").eqNullSafe(F.col("s")))
        edge = joined.filter("upto > left").groupBy("source").agg(F.min_by(F.struct("bucket", "n", "upto"), "bucket").alias("e"))
        cut = edge.select(F.col("source").alias("s"), (F.col("e.bucket") * F.lit(1 << rest)).alias("at"), (F.col("e.upto") - F.col("e.n")).alias("before"), F.col("e.n").alias("n"))
        state = state.drop("n").join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
        # No bucket passes the budget only if the documents end before it: all are taken.
        low = F.coalesce("at", F.lit(1 << 62).cast("long"))
        state = state.select("source", "source_size", "target", "whole", "budget", low.alias("low"), (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"), F.coalesce("n", F.lit(0)).alias("n"))
        state = spark.createDataFrame(state.collect(), state.schema)  # a row per source, at most MAX_SOURCES
    # The last bucket is one hash: take it if that comes nearer to the budget.
    cutoff = state.select(F.col("source").alias("s"), "source_size", "target", "whole", (F.col("low") + F.when(F.col("left") * 2 > F.col("n"), 1).otherwise(0)).alias("threshold"))
    times = F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return rows.join(F.broadcast(cutoff), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), "h")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixed rows themselves: each document as often as the mix takes it,
    so not at all, once or repeatedly, with its own columns, whatever their names.
    Nulls, empty texts, repeated rows and empty tables are as in `mix`."""
    own, h, times = unused("mix_id", docs), unused("mix_hash", docs), unused("mix_times", docs)
    copy, told = unused("mix_copy", docs), unused("mix_told", docs)
    chosen = mix(docs, id_col, text_col, **options).filter("times > 0").select(F.col("doc_id").alias(own), F.col("h").alias(told), F.col("times").alias(times)).distinct()
    hashed = docs.withColumn(h, F.shiftrightunsigned(F.xxhash64(id_col, text_col), 2))
    joined = hashed.join(chosen, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(h) == F.col(told)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
