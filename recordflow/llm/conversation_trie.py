"""Trie of conversation prefixes, rolled up by centroid decomposition of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordflow.llm.common import ship
from recordflow.runtime import checked_broadcast, cut_lineage, rank_in_groups

ship(__name__)

COMPONENT = 4_096        # components of this weight or less are split up within one task
TASK_NODES = 50_000      # nodes of such components per task, about
PIECE = 4_096            # ids joined to one text before the texts of a node are hashed in order
GROUP, CYCLE = 5, 9      # conversation c starts with up to crc32(c) % CYCLE turns of conversation c - c % GROUP


def rebuilt_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
    """(turns, conversations): rebuilt turns (conv_id, depth, k1, k2, n_bytes, length), and (conv_id, length) of each.

    k1 and k2 are 64-bit hashes of place, role and text. Turns are numbered in range partitions, so a hot
    conversation spreads over many tasks; at most eight turns of a conversation are copied, four times at most.
    """
    own = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    ).where("conv_id is not null")
    ranked = rank_in_groups(own, ["conv_id"], ["turn", "role", "text"], "n")
    size = cut_lineage(ranked.groupBy("conv_id").agg(F.count("*").alias("size")), "sizes")
    copied = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(CYCLE))
    known = size.select(
        "conv_id", "size", copied.alias("copied"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
    ).join(size.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    plan = cut_lineage(known.select(
        "conv_id", "base", "copied", F.least("copied", F.coalesce("base_size", F.lit(0))).alias("head"),
        F.greatest(F.col("size") - F.col("copied"), F.lit(0)).alias("tail")).withColumn("length", F.col("head") + F.col("tail")), "plan")

    def hashed(depth):
        place = F.col(depth).cast("long")
        return [place.alias("depth"), F.xxhash64(F.lit(1), place, "role", "text").alias("k1"), F.xxhash64(F.lit(2), place, "role", "text").alias("k2"),
                F.octet_length("text").cast("long").alias("n_bytes"), F.col("length").cast("long").alias("length")]

    head = ranked.where(F.col("n") < CYCLE).withColumnRenamed("conv_id", "base").join(
        plan.where("head > 0").select("conv_id", "base", "head", "length"), "base").where("n <= head").select("conv_id", *hashed("n"))
    tail = ranked.join(plan.where("tail > 0").select("conv_id", "copied", "head", "length"), "conv_id").where("n > copied").withColumn(
        "place", F.col("n") - F.col("copied") + F.col("head")).select("conv_id", *hashed("place"))
    return head.unionByName(tail), plan.select("conv_id", F.col("length").cast("long").alias("length"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Add p1 and p2, the exclusive or of k1 and of k2 up to each turn, over range partitions of a conversation."""
    ranged = cut_lineage(
        turns.repartitionByRange("conv_id", "depth").withColumn("_part", F.spark_partition_id()), "turn-ranges")
    sums = ranged.groupBy("_part", "conv_id").agg(F.bit_xor("k1").alias("s1"), F.bit_xor("k2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_part", "conv_id", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    inside = Window.partitionBy("_part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(shifts, ["_part", "conv_id"])
        .withColumns({f"p{i}": F.bit_xor(f"k{i}").over(inside).bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)})
        .drop("_part", "o1", "o2"))


def joined_ids_hash(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of rows (node, depth, conv_id): the ascending ids, comma-joined, as SHA-256.

    Ids are sorted over range partitions and joined to texts of ``PIECE`` ids at most; the few texts of a node
    are hashed in order as they stream by, so no group is ever gathered.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in batches:
            out = []
            for at in zip(*[c.to_pylist() for c in batch.columns]):
                if at[:2] != key or len(ids) == PIECE:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = at[:2], []
                ids.append(at[2])
            yield _rows(out)
        yield _rows([(*key, ids[0], ",".join(map(str, ids)))] if ids else [])

    def _rows(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["node", "depth", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for node, depth, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (node, depth) != key:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (node, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digests(out)
        yield _digests([(*key, sha.hexdigest())] if sha else [])

    def _digests(out):
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["node", "depth", "ends_sha256"])

    order = ["node", "depth", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        join, "node long, depth long, first long, ids string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(
        digest, "node long, depth long, ends_sha256 string")


def split_locally(frame: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of whole components (top, top_depth) by centroid decomposition, all of them round by round.

    Rows: node, depth, parent, top, top_depth, weight (of the subtree within the component), whole (the
    component's), leaves, saved. Gives a row per node with the sums that this and no earlier split adds.
    """
    rows = frame.sort_values("depth", kind="stable")
    node, depth = rows["node"].tolist(), rows["depth"].tolist()
    place = {k: i for i, k in enumerate(zip(node, depth))}
    above = [place.get((p, d - 1), -1) for p, d in zip(rows["parent"].tolist(), depth)]
    tops = list(zip(rows["top"].tolist(), rows["top_depth"].tolist()))
    component = [place[t] for t in tops]
    above = [a if a >= 0 and component[a] == c and i != c else -1 for i, (a, c) in enumerate(zip(above, component))]
    weight, whole = rows["weight"].tolist(), rows["whole"].tolist()
    value = list(zip(rows["leaves"].tolist(), rows["saved"].tolist()))
    sums = [[0, 0] for _ in node]
    active = list(range(len(node)))
    while active:
        centroid: dict[int, int] = {}
        for i in active:  # from the top down: the last one that holds over half of the weight is the centroid
            if 2 * weight[i] > whole[i]:
                centroid[component[i]] = i
        path = [i for i in active if 2 * weight[i] > whole[i]]
        under: dict[int, int] = {}
        total = {c: list(value[x]) for c, x in centroid.items()}
        for i in active:
            x = centroid[component[i]]
            if above[i] == x:
                under[i] = i
            elif above[i] in under:
                under[i] = under[above[i]]
            if i in under:
                total[component[i]][0] += value[i][0]
                total[component[i]][1] += value[i][1]
        lost = {c: weight[x] for c, x in centroid.items()}
        for i in path:
            sums[i][0] += total[component[i]][0]
            sums[i][1] += total[component[i]][1]
        removed = set(centroid.values())
        on_path = set(path)
        for i in active:
            if i in under:
                whole[i] = weight[under[i]]
            else:
                whole[i] -= lost[component[i]]
                if i in on_path:
                    weight[i] -= lost[component[i]]
        for i, y in under.items():
            if i == y:
                above[i] = -1
            component[i] = y
        active = [i for i in active if i not in removed]
    return pd.DataFrame({"node": node, "depth": depth, "leaves": [s[0] for s in sums], "saved": [s[1] for s in sums]})


def subtree_sums(nodes: DataFrame, members: DataFrame, whole: int) -> DataFrame:
    """(node, depth, leaves, saved): the sums of both columns over each node's subtree.

    ``nodes`` has node, depth, parent, weight, leaves, saved; ``members`` has a row (conv_id, depth, node)
    per conversation and node it passes. A node is named by its smallest member and its depth. ``weight``
    is the subtree's number of (conversation, node) pairs, known from the members without a rollup; ``whole``
    is the root's.

    In a round every component heavier than ``COMPONENT`` is split at its centroid, the deepest node with
    over half of the weight; the nodes with over half are the path from there to the top. The total of
    the centroid's subtree within the component is added along that path, each child of the centroid
    becomes the top of a component of its own, and the rest keeps the old top. Weights halve, so the
    logarithm of ``whole`` bounds the rounds. Lighter components are split further inside tasks.
    """
    key = ["top", "top_depth"]
    root = nodes.where("depth = 0").first()
    if root is None:
        return nodes.select("node", "depth", "leaves", "saved")
    active = nodes.select(
        "node", "depth", "parent", "weight", "leaves", "saved", F.lit(root["node"]).cast("long").alias("top"),
        F.lit(0).cast("long").alias("top_depth"), F.lit(whole).cast("long").alias("whole"))
    added, light = [], []
    over_half = F.col("weight") * 2 > F.col("whole")
    while True:
        light.append(active.where(F.col("whole") <= COMPONENT))
        heavy = active.where(F.col("whole") > COMPONENT)
        if heavy.isEmpty():
            break
        least = F.min_by(F.struct("node", "depth", "weight"), "weight")
        centroids = cut_lineage(heavy.where(over_half).groupBy(*key).agg(least.alias("x")).select(
            *key, *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("node", "depth", "weight")]), "centroids")
        placed = heavy.join(checked_broadcast(centroids), key)
        tops = placed.where((F.col("parent") == F.col("x_node")) & (F.col("depth") == F.col("x_depth") + 1)).select(
            *key, F.col("node").alias("y"), F.col("depth").alias("y_depth"), F.col("weight").alias("y_weight"))
        moved = members.join(tops, (members["node"] == F.col("y")) & (members["depth"] == F.col("y_depth"))).select(
            F.col("conv_id").alias("node"), *key, "y", "y_depth", "y_weight")
        marked = cut_lineage(
            placed.join(moved, ["node", *key], "left")
            .withColumn("under", F.col("y").isNotNull() & (F.col("depth") > F.col("x_depth")))
            .withColumn("cut", (F.col("node") == F.col("x_node")) & (F.col("depth") == F.col("x_depth"))), "split")
        totals = cut_lineage(marked.where("under OR cut").groupBy(*key).agg(
            F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved")), "totals")
        added.append(marked.where(over_half).join(checked_broadcast(totals), key).select(
            "node", "depth", F.col("t_leaves").alias("leaves"), F.col("t_saved").alias("saved")))
        active = marked.where("NOT cut").select(
            "node", "depth", "parent",
            F.when(~F.col("under") & over_half, F.col("weight") - F.col("x_weight")).otherwise(F.col("weight")).alias("weight"), "leaves", "saved",
            F.when(F.col("under"), F.col("y")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("under"), F.col("y_depth")).otherwise(F.col("top_depth")).alias("top_depth"),
            F.when(F.col("under"), F.col("y_weight")).otherwise(F.col("whole") - F.col("x_weight")).alias("whole"))
    small = light[0]
    for more in light[1:]:
        small = small.unionByName(more)
    tasks = small.count() // TASK_NODES + 1
    sums = small.groupBy(F.pmod(F.xxhash64(*key), F.lit(tasks)).alias("task")).applyInPandas(
        lambda frame: split_locally(frame), "node long, depth long, leaves long, saved long")
    for more in added:
        sums = sums.unionByName(more)
    return sums.groupBy("node", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn, null first, then role and text; null roles and texts count as empty. Rows without a
    conv_id take no part. Repeated rows are turns of their own. Prefixes are told apart by 128 bits of
    hashes of place, role and text. Sums over subtrees come from ``subtree_sums``. An empty table gives
    no rows, other columns are ignored.
    """
    turns, known = rebuilt_turns(conversations, conv_id, turn, role, text)
    paths = cut_lineage(prefix_hashes(turns), "prefixes")
    top = known.agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n"), F.sum(F.col("length") + 1).alias("weight"),
        F.count_if(F.col("length") == 0).alias("ends")).first()
    spark = conversations.sparkSession
    kinds = "node long, depth long, parent long, n_convs long, weight long, leaves long, saved long"
    roots = [(top["node"], 0, top["node"], top["n"], top["weight"], int(top["ends"] == top["n"]), 0)] if top["n"] else []
    step = ["depth", "p1", "p2"]
    found = cut_lineage(paths.groupBy(*step).agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.count_if(F.col("length") == F.col("depth")).alias("ends"),
        *[F.max(F.col(f"p{i}").bitwiseXOR(F.col(f"k{i}"))).alias(f"q{i}") for i in (1, 2)]), "prefix-nodes")
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("node").alias("parent"))
    sums = ["n_convs", "weight", (F.col("ends") == F.col("n_convs")).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")]
    first = found.where("depth = 1").select("node", "depth", F.lit(top["node"]).cast("long").alias("parent"), *sums)
    later = found.where("depth > 1").join(above, ["depth", "q1", "q2"]).select("node", "depth", "parent", *sums)
    nodes = cut_lineage(first.unionByName(later).unionByName(spark.createDataFrame(roots, kinds)), "trie")
    members = cut_lineage(paths.select("conv_id", "length", *step).join(found.select("node", *step), step).select(
        "conv_id", "depth", "node", "length"), "members")
    rolled = subtree_sums(nodes, members, top["weight"] or 0)
    ends = members.where("depth = length").select("node", "depth", "conv_id").unionByName(
        known.where("length = 0").select(F.lit(top["node"]).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    at = ["node", "depth"]
    return (
        nodes.select(*at, "parent", "n_convs").join(rolled, at).join(children, at, "left").join(joined_ids_hash(ends), at, "left")
        .select(
            F.col("node").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
