"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import WORD, fresh, text_or_empty, total_before
from recordflow.runtime import by_shuffle, cut_lineage, distributed_rank

WEIGHTS = (5, 2, 1)    # of the sources by code point, repeating; null is the last source
SHARE = 1.5            # words of the mix for each word there is
LIMIT = 2              # times a source's words that the mix takes at most
BLOCK = 128            # words of a block
SHARD = 4_096          # blocks of an output shard
SEED = 20
_ROUNDS = 6            # of the index permutation
_RUN = 65_536          # numbers dealt to a task together
_TASK_SLOTS, _MOST_TASKS = 100_000, 100_000  # slots a task makes, and tasks


def _rows(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """(doc_id, tie, source, size) of every row."""
    body = text_or_empty(f"`{text}`")
    return cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("tie"), F.col(source).cast("string").alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size")), "mix-rows")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, rank, weight, source_size, target) of every source of ``rows`` (source, size).

    Sources weigh ``weights`` by code point, repeating, null last, and share ``share`` times all words; a
    target stops at ``limit`` times its source's words and the excess goes to the others by weight, until
    none is above. Only one sum over the sources is taken per round.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", F.col("source").isNull().alias("last"))
    ranked = distributed_rank(sizes, ["last", "source"], "rank").withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = cut_lineage(ranked.drop("last"), "sources")
    cap = F.col("source_size") * float(limit)
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:
        full = cap <= F.col("weight") * level if held >= 0 else F.lit(False)
        count, used, free = ranked.agg(
            F.sum(full.cast("long")), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if count is None or count == held or not free:
            break
        held, level = count, (total - used) / free
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level))


def _permuted(slots: DataFrame, index: str, size: str, key: list[str], seed: int) -> DataFrame:
    """Send ``index`` through a permutation of 0 .. ``size`` - 1 that depends on ``key``.

    Each round mirrors an index at a keyed point and swaps the two or leaves them, by a bit both agree on.
    """
    def turn(now: Column, n: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, F.lit(seed), n), F.col(size)) - now, F.col(size))
        swap = F.xxhash64(*key, F.greatest(now, mirror), F.lit(seed), -1 - n).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(now)

    rounds = F.sequence(F.lit(0), F.lit(_ROUNDS - 1))
    return slots.withColumn(index, F.aggregate(rounds, F.col(index), turn))


def _numbered(df: DataFrame, count: str, out: str) -> DataFrame:
    """A row for each number from 0 to below ``count``, dealt to tasks in runs."""
    low = F.col("_run") * _RUN
    runs = df.where(F.col(count) > 0).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / _RUN))))
    return runs.repartition("rank", "_run").withColumn(
        out, F.explode(F.sequence(low, F.least(F.col(count), low + _RUN) - 1))).drop("_run")


def draw(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """The mix as rows (shard, rank, pass, block): which block of which source each slot of a shard takes.

    A source's slots over all shards are its expected number, rounded up or down: the fractions of all
    sources follow one another on a line, and those that one of the points u, u + 1, u + 2 .. falls into are
    rounded up. A shard's count of a source is the whole part of an equal share of these slots plus a
    multinomial draw of what the whole parts leave over, so shards have about ``shard`` blocks. The source's
    slots over all shards are numbered; slot n takes the block that the n-th place of a pseudorandom
    permutation of the source's blocks names, and starts over with another permutation when all are taken.
    A source gives no block more than ``limit`` times, as it has no more slots.
    """
    known = sources.where("source_size > 0 AND target > 0").withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn(
        "wanted", F.least(F.col("target") * F.col("blocks") / F.col("source_size"), (F.col("blocks") * limit).cast("double")))
    known = known.select("rank", "blocks", "wanted", (F.col("wanted") - F.floor("wanted")).alias("part"), F.lit(0).alias("all"))
    shift = F.pmod(F.xxhash64(F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    up = F.floor(F.col("low") + F.col("part") + shift) - F.floor(F.col("low") + shift)
    known = cut_lineage(total_before(known, ["all"], ["rank"], "part", "low").select(
        "rank", "blocks", F.least(F.floor("wanted") + up, F.col("blocks") * limit).alias("slots")), "mix-sources")
    slots = known.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-slots // shard))
    whole = known.select("rank", F.floor(F.col("slots") / shards).alias("count"), F.lit(shards).cast("long").alias("shards"))
    rest = known.select("rank", F.pmod("slots", F.lit(shards)).alias("rest"))
    counts = _numbered(whole.where("count > 0"), "shards", "shard").select("shard", "rank", "count").unionByName(
        _numbered(rest, "rest", "n").select(
            F.pmod(F.xxhash64("rank", "n", F.lit(seed)), F.lit(shards)).alias("shard"), "rank", F.lit(1).cast("long").alias("count"))
    ).groupBy("shard", "rank").agg(F.sum("count").alias("count"))
    placed = total_before(counts, ["rank"], ["shard"], "count", "start").join(known.select("rank", "blocks"), "rank")
    # Few rows become many: they are dealt by the number of slots, which is known.
    tasks = max(1, min(_MOST_TASKS, -(-slots // _TASK_SLOTS)))
    slot = (
        placed.repartition(tasks, "rank", "shard")
        .select("shard", "rank", "blocks", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("n"))
        .select("shard", "rank", "blocks", F.floor(F.col("n") / F.col("blocks")).alias("pass"), F.pmod("n", "blocks").alias("block")))
    return _permuted(slot, "block", "blocks", ["rank", "pass"], seed).drop("blocks")


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """The parts of blocks that each document fills: (.., block, first, words), ``first`` a word of the document."""
    end = F.col("offset") + F.col("size")
    low = F.greatest(F.col("offset"), F.col("block") * block)
    return rows.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("offset") / block), F.floor((end - 1) / block)))).select(
        "rank", "offset", "block", (low - F.col("offset")).alias("first"),
        (F.least(end, (F.col("block") + 1) * block) - low).alias("words"))


def _packed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the rank of their source and their offset in its stream of words."""
    named = rows.join(sources.select(F.col("source").alias("s"), "rank", "source_size", "target"),
                      F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return cut_lineage(total_before(named, ["rank"], ["doc_id", "tie"], "size", "offset"), "packed")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK,
        shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target and taken, the words the mix takes of it.

    A source's documents in order of their ids (then of their texts' hash) are one stream of words, cut
    into blocks of ``block`` words; the mix draws blocks. Null texts have no words, null is the last
    source, null ids come first. Of rows that repeat each has its own words. Reruns give the same rows;
    an empty table gives none; other columns are ignored.
    """
    rows = _rows(docs, id_col, text, source)
    sources = cut_lineage(targets(rows), "targets")
    packed = _packed(rows, sources)
    picks = draw(sources, block, shard, seed=seed).groupBy("rank", "block").agg(F.count("*").alias("picks"))
    taken = by_shuffle(_pieces(packed, block)).join(by_shuffle(picks), ["rank", "block"]).groupBy("rank", "offset").agg(
        F.sum(F.col("words") * F.col("picks")).alias("words"))
    return packed.join(taken, ["rank", "offset"], "left").select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
        F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                    block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row per document and pass, its text the words taken.

    Words keep the white space before them; a document whose blocks are all taken keeps its whole text.
    Documents of which nothing is taken are absent. ``n_chars``, where there is such a column, follows
    the text. Rows equal in id, text and source share their words.
    """
    rows = _rows(docs, id_col, text, source)
    sources = cut_lineage(targets(rows), "targets")
    packed = _packed(rows, sources)
    picks = draw(sources, block, shard, seed=seed)
    sized = packed.select("rank", "offset", "size", "doc_id", "tie", "source").where("size > 0")
    taken = (
        by_shuffle(_pieces(packed, block)).join(by_shuffle(picks), ["rank", "block"]).join(by_shuffle(sized), ["rank", "offset"])
        .groupBy("rank", "offset", "pass", "doc_id", "tie", "source", "size")
        .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs"), F.sum("words").alias("words")))
    tag = {n: fresh(docs, n) for n in ("_id", "_tie", "_source", "_runs", "_pass", "_whole", "_body")}
    chosen = cut_lineage(taken.select(
        F.col("doc_id").alias(tag["_id"]), F.col("tie").alias(tag["_tie"]), F.col("source").alias(tag["_source"]),
        F.col("runs").alias(tag["_runs"]), F.col("pass").alias(tag["_pass"]), (F.col("words") == F.col("size")).alias(tag["_whole"])), "mix-runs")
    body = text_or_empty(f"`{text}`")
    keyed = docs.withColumn(tag["_body"], F.xxhash64(body))
    joined = keyed.join(by_shuffle(chosen), F.col(f"`{id_col}`").eqNullSafe(F.col(tag["_id"])) & (F.col(tag["_body"]) == F.col(tag["_tie"]))
                        & F.col(f"`{source}`").cast("string").eqNullSafe(F.col(tag["_source"])))
    words = F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(F.col(tag["_runs"]), lambda r: F.slice(words, r["first"].cast("int") + 1, r["words"].cast("int")))), "")
    joined = joined.withColumn(text, F.when(F.col(tag["_whole"]), body).otherwise(cut))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
