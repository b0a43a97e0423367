"""Exact dedup on an extendible-hash index; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import bitmap_of, fresh, in_bitmap, text_or_empty
from recordflow.runtime import cut_lineage

BUCKET_KEYS = 4_096   # keys of a bucket before it splits
_FINEST = 32          # bits after which a bucket chains instead of splitting


def _prefix(depth: int, key: str = "h"):
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(bucket, depth) rows of the buckets that ``keys`` (one row per hash ``h``) need, and the global depth.

    A bucket is a prefix of the hash. One that holds more than ``bucket_keys`` keys splits on the next
    bit, and the directory doubles when a split goes deeper than it. Only counts by prefix are looked at.
    """
    counts = cut_lineage(keys.groupBy(_prefix(_FINEST).alias("h")).agg(F.count("*").alias("n")), "prefixes")
    depth, found, open_ = 0, None, counts
    while True:
        prefix = F.shiftrightunsigned(F.col("h"), _FINEST - depth)
        sizes = open_.groupBy(prefix.alias("bucket")).agg(F.sum("n").alias("n"))
        fits = (F.col("n") <= bucket_keys) if depth < _FINEST else F.lit(True)
        level = cut_lineage(sizes.select("bucket", F.lit(depth).alias("depth"), fits.alias("fits")), "directory")
        closed = level.where("fits").select("bucket", "depth")
        found = closed if found is None else found.unionByName(closed)
        if level.where("not fits").isEmpty():
            return found, depth
        full = level.where("not fits").select("bucket")
        open_ = open_.join(full, prefix == F.col("bucket"), "left_semi")
        depth += 1


def build_index(rows: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The index of ``rows`` (h, doc_id) as files in the shared folder: (bucket, depth, h, n, last).

    Copies of a key are combined before they move, so a hot key is one entry. Owner tasks take ranges
    of keys: buckets in hash order, each task's file sorted by key.
    """
    keys = cut_lineage(rows.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")), "keys")
    buckets, depth = directory(keys, bucket_keys)
    pointers = buckets.select(
        "bucket", "depth",
        F.explode(F.sequence(
            F.call_function("shiftleft", F.col("bucket"), F.lit(depth) - F.col("depth")),
            F.call_function("shiftleft", F.col("bucket") + 1, F.lit(depth) - F.col("depth")) - 1)).alias("slot")) if depth else (
        buckets.select("bucket", "depth", F.lit(0).cast("long").alias("slot")))
    owned = keys.join(pointers, _prefix(depth) == F.col("slot")).drop("slot")
    ordered = owned.repartitionByRange(F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).sortWithinPartitions("depth", "bucket", "h")
    return cut_lineage(ordered, "hash-index")


def _chains(docs: DataFrame, id_col: str, text: str, bucket_keys: int) -> tuple[DataFrame, str, str, str]:
    """``docs`` with its whole text, hash key and whether other rows may have that key; the three names."""
    body, key, maybe = fresh(docs, "_text"), fresh(docs, "_h"), fresh(docs, "_maybe")
    hashed = docs.withColumn(body, text_or_empty(f"`{text}`")).withColumn(key, F.xxhash64(body))
    index = build_index(hashed.select(F.col(key).alias("h"), F.col(f"`{id_col}`").alias("doc_id")), bucket_keys)
    several = bitmap_of(index.where("n > 1").select("h"), "h")
    return in_bitmap(hashed, F.col(key), several, maybe), body, key, maybe


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The largest id of a group stays; null
    ids are below all others, and a group of null ids alone has keep_id null. Rows that repeat with id
    and text are each marked as kept. The hash index finds keys with several rows; only those rows are
    chained, by comparing whole texts, with partial combining, so a hot text is one entry per task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    marked, _, _, _ = _chains(rows, "doc_id", "text", bucket_keys)
    several = marked.where("_maybe")
    digest = F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
    single = marked.where("not _maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), digest)
    chains = cut_lineage(
        several.groupBy("_h", "_text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.col("_h").alias("k"), F.col("_text").alias("bytes"), "keep_id", "group_size"), "chains")
    grouped = several.join(chains, (F.col("_h") == F.col("k")) & (F.col("_text") == F.col("bytes"))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), digest)
    return single.unionByName(grouped)


def keep_last(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of ``docs`` of which one stays per text: that of the largest id.

    Of rows with equal text and id the greatest by the other columns stays, so exactly one row does.
    """
    marked, body, key, maybe = _chains(docs, id_col, text, bucket_keys)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = [F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in docs.columns if c != id_col]]
    best = marked.where(F.col(maybe)).groupBy(key, body).agg(F.max(F.struct(*order)).alias("best"))
    kept = best.select(*[F.col("best").getField(c).alias(c) for c in docs.columns])
    return marked.where(~F.col(maybe)).select(*columns).unionByName(kept)
