"""SimHash near-duplicates: pivot distance tables discard pairs, exact distances verify the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import bitmap_of, by_text, fresh, in_bitmap, ship
from recordflow.llm.graph import components
from recordflow.runtime import by_shuffle, cut_lineage

ship(__name__)

SHINGLE = 4      # words of a shingle
SEED = 42        # of the shingle hash
MAX_BITS = 4     # fingerprints link at this many differing bits or fewer
PIVOTS = 16      # reference fingerprints
_BLOCKS = 6      # at most 4 of 6 blocks can differ, so two agree


def _fingerprint(data: bytes, width: int) -> int:
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        spans = [(0, len(joined))]
    else:
        starts = np.concatenate(([0], ends[:-width] + 1))
        spans = zip(starts.tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = SHINGLE) -> DataFrame:
    """Every row with ``out``: its text's 64-bit SimHash as a signed long.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a shingle is ``width`` words
    joined by spaces, repeats counted; a shorter text is one shingle; null, empty or blank texts get 0.
    One narrow pass; only the text and the other columns of the row are held.
    """
    def values(texts: Iterator[str]) -> np.ndarray:
        return np.array([_fingerprint(t.encode(), width) for t in texts], dtype=np.uint64).view(np.int64)

    return by_text(docs, text, out, "long", values)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _pivots(count: int) -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED)) for i in range(count)]


def _masks() -> list[int]:
    cuts = [round(64 * i / _BLOCKS) for i in range(_BLOCKS + 1)]
    return [_signed(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(cuts, cuts[1:])]


def links(prints: DataFrame, fingerprint: str = "fingerprint", max_bits: int = MAX_BITS, pivots: int = PIVOTS) -> DataFrame:
    """All pairs (a, b), a < b, of distinct values of ``fingerprint`` that differ in 1 to ``max_bits`` bits.

    ``prints`` has one row per value. The pivot table holds each value's Hamming distances to the
    reference fingerprints; a pair whose distances to any of them differ by more than ``max_bits`` is
    out by the triangle inequality, and what is left is verified bit by bit. Distances to a few pivots
    lie close together in 64 dimensions, so pivots alone would still compare all pairs: pairs are met
    on two agreeing blocks out of six instead (four differing bits leave two whole), and the first
    agreeing key alone reports a pair. ``max_bits`` may be 4 at most.
    """
    if max_bits > _BLOCKS - 2:
        raise ValueError(f"max_bits may be {_BLOCKS - 2} at most")
    value = F.col(fingerprint)
    packed = []
    refs = _pivots(pivots)
    for at in range(0, pivots, 8):  # eight distances of 7 bits to a long
        word: Column = F.lit(0).cast("long")
        for k, ref in enumerate(refs[at:at + 8]):
            word = word.bitwiseOR(F.shiftleft(F.bit_count(value.bitwiseXOR(F.lit(ref))).cast("long"), 7 * k))
        packed.append(word.alias(f"d{at // 8}"))
    masks = _masks()
    keys = F.array(*[
        F.struct(F.lit(j).alias("j"),
                 F.xxhash64(F.lit(i), F.lit(j), F.col("f").bitwiseAND(F.lit(masks[i])), F.col("f").bitwiseAND(F.lit(masks[j]))).alias("key"))
        for j in range(_BLOCKS) for i in range(j)])
    rows = prints.where(value.isNotNull()).select(value.alias("f"), *packed).select("*", F.inline(keys))
    left, right = by_shuffle(rows).alias("x"), rows.alias("y")
    differ = F.col("x.f").bitwiseXOR(F.col("y.f"))
    near = []
    for k in range(pivots):
        distance = [F.shiftright(F.col(f"{side}.d{k // 8}"), 7 * (k % 8)).bitwiseAND(F.lit(127)) for side in "xy"]
        near.append(F.abs(distance[0] - distance[1]))
    agree = sum(((F.lit(k) < F.col("x.j")) & (differ.bitwiseAND(F.lit(m)) == 0)).cast("int") for k, m in enumerate(masks[:-1]))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.f") < F.col("y.f"))
    close = F.greatest(*near) <= max_bits
    return left.join(right, met & close & (F.bit_count(differ) <= max_bits) & (agree == 1)).select(
        F.col("x.f").alias("a"), F.col("y.f").alias("b"))


def classes(printed: DataFrame, id_col: str = "doc_id", fingerprint: str = "fingerprint", max_bits: int = MAX_BITS) -> DataFrame:
    """(fingerprint, component_id) for every distinct value: the smallest id among the rows reachable over links.

    Rows of one value count as one node, so a group of copies costs one row here. A null id is
    never the smallest; a component of null ids alone has a null component_id.
    """
    value = F.col(fingerprint)
    nodes = cut_lineage(printed.where(value.isNotNull()).groupBy(value.alias("f")).agg(F.min(id_col).alias("least")), "prints")
    found = components(links(nodes, "f", max_bits), "a", "b")
    rooted = cut_lineage(nodes.join(found, nodes.f == found.node, "left").select(
        "f", "least", F.coalesce("component", "f").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut_lineage(rooted.join(smallest, "root").select(F.col("f").alias(fingerprint), "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 lower-case hex digits) and ``component_id``.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and ties share
    their component. An empty table gives no rows; other columns are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    printed = cut_lineage(with_fingerprint(rows).select("doc_id", "fingerprint"), "fingerprints")
    named = classes(printed, max_bits=max_bits)
    return printed.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` of which one stays per component: that of the smallest id.

    An id that several rows carry stays with all of them if it is the smallest of any of their
    components. Rows with a null id stay if their component has null ids alone. Only rows whose id may
    be among those to drop are joined, the others pass by a bitmap of fixed size.
    """
    printed = cut_lineage(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).select(
        "doc_id", "fingerprint"), "fingerprints")
    named = classes(printed, max_bits=max_bits)
    stays = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull())
    name, maybe = fresh(docs, "_gone"), fresh(docs, "_maybe")
    gone = cut_lineage(
        printed.join(named, "fingerprint").groupBy("doc_id").agg(F.max(stays).alias("stays"))
        .where(~F.col("stays")).select(F.col("doc_id").alias(name)), "dropped")
    key = F.xxhash64(F.col(f"`{id_col}`"))
    bitmap = bitmap_of(gone.select(F.xxhash64(name).alias("key")), "key")
    marked = in_bitmap(docs, key, bitmap, maybe)
    rest = marked.where(F.col(maybe)).join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")
    return marked.where(~F.col(maybe)).unionByName(rest).drop(maybe)
