"""Streaming form of the long mapping.

The state is the distinct candidates of every id, cut into buckets by id. A micro-batch reduces its rows,
merges them with the buckets it touches and writes these buckets anew under its batch number; other
buckets stay where they are. A manifest of one row per bucket names the version that counts. The
batch number is the fence: a replayed batch builds on the versions before it and overwrites its own. Two
manifests are kept, of the last batch and of the one before it, each replaced as a whole. Reading
takes one version of each bucket, whatever the number of batches, and needs no aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordflow.operators.mapping import Rule, first_places, long_candidates, map_long_flat, pack_place
from recordflow.runtime import cut_lineage, spread

BUCKETS = 16
_MANIFEST = "at long, bucket int, batch long"


def _manifests(spark: SparkSession, log_path: str) -> dict[int, dict[int, int]]:
    """Of the last batch and the one before it: the batch that last wrote each bucket."""
    known: dict[int, dict[int, int]] = {}
    for slot in (0, 1):
        try:
            rows = spark.read.schema(_MANIFEST).parquet(f"{log_path}/manifest/slot={slot}").collect()
        except AnalysisException:  # not written yet
            continue
        for r in rows:
            known.setdefault(r["at"], {})[r["bucket"]] = r["batch"]
    return known


def _write_manifest(spark: SparkSession, log_path: str, slot: int, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{log_path}/manifest/slot={slot}")


def _read_buckets(spark: SparkSession, log_path: str, versions: dict[int, int], buckets: list[int]) -> DataFrame | None:
    """The given buckets' rows in their versions."""
    paths = [f"{log_path}/state/batch={versions[b]}/bucket={b}" for b in buckets if b in versions]
    return spark.read.parquet(*paths) if paths else None


def merge_batch(id_col: str, name_col: str, value_col: str, order_col: str, rules: list[Rule],
                log_path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """The function of (batch, batch number) that merges a micro-batch into the state.

    A row without a field stands for an id, matched or not. Large buckets are written by several
    tasks, so an id that holds most of the rows is not one task's work.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A micro-batch is often one file, which one task would read and reduce alone.
        dealt = spread(batch.select(*dict.fromkeys([id_col, name_col, value_col, order_col])))
        found = long_candidates(dealt, id_col, name_col, value_col, order_col, rules)
        ids = batch.where(F.col(id_col).isNotNull()).select(id_col).distinct()
        new = cut_lineage(
            found.unionByName(ids, allowMissingColumns=True)
            .withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int")), "incoming")
        known = _manifests(spark, log_path)
        before = [at for at in known if at < batch_id]
        if known and batch_id and not before:
            raise ValueError(f"the state before batch {batch_id} is gone; start again from batch 0")
        versions = dict(known[max(before)]) if before else {}
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        rows = new.drop("bucket")
        old = _read_buckets(spark, log_path, versions, touched)
        if old is not None:
            rows = rows.unionByName(old)
        merged = first_places(rows.withColumn("_place", pack_place(F.col("rule_ord"), F.col("row_ord"))), id_col)
        placed = merged.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int"))
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/state/batch={batch_id}")
        versions |= dict.fromkeys(touched, batch_id)
        _write_manifest(spark, log_path, batch_id % 2, [(batch_id, b, v) for b, v in sorted(versions.items())])
        if any(at > batch_id for at in known):  # of a run that this one replays
            _write_manifest(spark, log_path, 1 - batch_id % 2, [(max(before), b, v) for b, v in known[max(before)].items()] if before else [])

    return merge


def start_long_records(stream: DataFrame, id_col: str, name_col: str, value_col: str, order_col: str,
                       rules: list[Rule], log_path: str, checkpoint_path: str,
                       trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Start the stream, by default over everything available and then stopping; ``trigger`` takes
    the writer's trigger options. Both paths must be reachable by all executors."""
    merge = merge_batch(id_col, name_col, value_col, order_col, rules, log_path, buckets)
    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint_path).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_log(spark: SparkSession, log_path: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, ids) as of the last batch, each value at its first place."""
    known = _manifests(spark, log_path)
    versions = known[max(known)] if known else {}
    state = _read_buckets(spark, log_path, versions, list(versions))
    if state is None:
        raise ValueError(f"no batch has been written to {log_path}")
    return state.where("field is not null"), state.where("field is null").select(id_col)


def long_records(spark: SparkSession, log_path: str, id_col: str, rules: list[Rule], **options) -> DataFrame:
    """Flat records from the state."""
    candidates, ids = read_log(spark, log_path, id_col)
    return map_long_flat(ids, id_col, "", "", "", rules, candidates=candidates, **options)
