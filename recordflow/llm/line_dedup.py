"""Line dedup by an exact set-similarity join: rarity order, prefix, length and positional filters, verification in groups."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import bitmap_bytes, bitmap_of, ship, text_or_empty
from recordflow.runtime import cut_lineage

ship(__name__)

NUM, DEN = 4, 5            # lines match from a Jaccard similarity of NUM / DEN on
BUCKETS = 1 << 23          # of the sketch of token counts, four bytes each: 32 MiB whatever the input
_SLICES = 64
_HASH_BITS = 56
_MOST = 2**32 - 1
MEMO_KEYS = 1_000_000      # keys of lines that a task has sent, remembered before it starts anew
BLOCK = 4_096              # members of a token's group that are compared in one piece; larger groups are cut
_SLICE = 200               # texts whose words are hashed together
_ROWS, _BYTES = 65_536, 16 << 20  # members compared together, whole groups
_AT_ONCE = 500_000         # tokens looked up together when pairs are verified
_SHORT = 32                # bytes of a word that are hashed eight at a time
_SOLID = bytes(b not in b" \t\n\v\f\r" for b in range(256))
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[1]
    x ^= x >> np.uint64(32)
    x *= _ODD[2]
    return x ^ (x >> np.uint64(29))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line and hash of every word, A-Z lower-cased, and the first line of every text; lines count on over the texts."""
    data = b"\n".join(texts).lower() + b" " * _SHORT
    buf = np.frombuffer(data, np.uint8)
    solid = np.frombuffer(b"\0" + data.translate(_SOLID), np.bool_)  # data ends in blanks
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes = sizes.astype(np.uint64) * _ODD[0]
    for done in range(0, _SHORT, 8):
        at = np.flatnonzero(sizes > done) if done else slice(None)
        part = eight[starts[at] + done] & _MASKS[np.minimum(sizes[at] - done, 8)]
        hashes[at] = _mix(hashes[at] ^ part)
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i]:starts[i] + sizes[i]])
    before = np.searchsorted(starts, np.flatnonzero(buf == 10))  # words before each line feed
    lines = np.repeat(np.arange(len(before) + 1), np.diff(before, prepend=0, append=len(starts)))
    first = np.cumsum([0, *[t.count(b"\n") + 1 for t in texts]])
    return lines, hashes & np.uint64((1 << _HASH_BITS) - 1), first


def _by_line(lines: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The order by line, then token: by their leading bits, unless these are equal for different tokens."""
    bits = int(lines[-1]).bit_length() if len(lines) else 0
    leading = (lines.astype(np.uint64) << np.uint64(63 - bits)) | (tokens >> np.uint64(bits)) if bits else tokens
    order = np.argsort(leading)
    leading = leading[order]
    same = np.flatnonzero(leading[1:] == leading[:-1])
    if (tokens[order[same + 1]] != tokens[order[same]]).any():
        return np.lexsort((tokens, lines))
    return order


class Lines:
    """The lines with words of some texts as sets of tokens, in one array after the other.

    A token is its word's hash below the level of its bucket's count, so that numbers sort by rarity; a
    line's tokens are sorted. ``key`` is a hash of the set, ``parity`` the parity of its tokens in 128 classes,
    as two numbers: sets that differ in d tokens differ in d bits at most.
    """

    def __init__(self, texts: list[bytes], counts: np.ndarray):
        lines, hashes, first = _words(texts)
        seen = counts[(hashes % np.uint64(BUCKETS)).astype(np.int64)]
        level = np.minimum(np.floor(np.log2(np.maximum(seen, 1)) * 4), 127).astype(np.uint64)
        tokens = (level << np.uint64(_HASH_BITS)) | hashes
        order = _by_line(lines, tokens)
        tokens, lines, seen = tokens[order], lines[order], seen[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (lines[1:] != lines[:-1])
        self.tokens, self.seen, lines = tokens[new], seen[new], lines[new]
        self.start = np.flatnonzero(np.diff(lines, prepend=-1))
        self.size = np.diff(self.start, append=len(lines))
        line = lines[self.start]
        self.text = np.searchsorted(first, line, side="right") - 1
        self.number = line - first[self.text]
        none = np.zeros(0, np.uint64)
        known = _mix(self.tokens & np.uint64((1 << _HASH_BITS) - 1))
        self.key = (np.add.reduceat(known, self.start) if len(line) else none).view(np.int64)

    @cached_property
    def parity(self) -> list[np.ndarray]:
        classes, second = np.uint64(1) << (self.tokens & np.uint64(63)), (self.tokens & np.uint64(64)) > 0
        halves = [np.where(second == half, classes, np.uint64(0)) for half in (False, True)]
        return [(np.bitwise_xor.reduceat(x, self.start) if len(x) else x).view(np.int64) for x in halves]

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token of the lines ``at``: its line's place in ``at``, and its own place in all tokens."""
        return _ragged(self.start[at], self.size[at])


def _ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            part = batch.slice(start, _SLICE)
            yield part, part.column(column).cast(pa.binary()).to_pylist()


def _unsent(key: np.ndarray, done: set[int]) -> np.ndarray:
    """Places of the keys that are met for the first time, each once."""
    if len(done) > MEMO_KEYS:
        done.clear()
    at = [i for i in np.sort(np.unique(key, return_index=True)[1]).tolist() if int(key[i]) not in done]
    done.update(key[at].tolist())
    return np.array(at, dtype=np.int64)


def token_counts(texts: DataFrame) -> np.ndarray:
    """For each bucket of token hashes: how often its tokens stand in the texts, 2 ** 32 - 1 at most.

    Every task counts its own words; slices of the sketches are added up in parallel. The sketch has a
    fixed size, so the whole of it may reach the driver and be broadcast.
    """
    width = BUCKETS // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.uint32)
        for _, found in _slices(batches, 0):
            places, n = np.unique((_words(found)[1] % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
            counts[places] = np.minimum(_MOST, counts[places].astype(np.int64) + n)
        used = [i for i in range(_SLICES) if counts[i * width:(i + 1) * width].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([zlib.compress(counts[i * width:(i + 1) * width].tobytes(), 1) for i in used], pa.binary())],
            names=["slice", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch["slice"], batch["counts"]):
                part = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
                sums[at] = np.minimum(_MOST, part + sums[at]) if at in sums else part
        yield pd.DataFrame({"slice": list(sums), "counts": [zlib.compress(s.astype(np.uint32).tobytes(), 1) for s in sums.values()]})

    schema = "slice int, counts binary"
    summed = texts.mapInArrow(count, schema).repartition(_SLICES, "slice").mapInPandas(add, schema)
    whole = np.zeros(BUCKETS, dtype=np.uint32)
    for row in summed.collect():
        whole[row["slice"] * width:(row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return whole


def _group(token: np.ndarray, seen: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The group of a token in which two blocks of its members meet; a token of one block is its own group."""
    blocks = _blocks(seen)
    cell = (np.minimum(one, other) * blocks + np.maximum(one, other) + 1).astype(np.uint64)
    return np.where(blocks > 1, _mix(token.view(np.uint64) ^ _mix(cell)), token.view(np.uint64)).view(np.int64)


def _blocks(seen: np.ndarray) -> np.ndarray:
    return np.maximum(1, (seen.astype(np.int64) + BLOCK - 1) // BLOCK)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by their first column, in larger batches that end where a group does."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and (sum(b.num_rows for b in held) >= _ROWS or sum(b.nbytes for b in held) >= _BYTES):
            g = batch.column(0).to_numpy()
            change = np.flatnonzero(np.diff(g, prepend=held[-1].column(0)[-1].as_py()))
            if len(change):
                if change[0]:
                    held.append(batch.slice(0, int(change[0])))
                yield joined()
                held = []
                batch = batch.slice(int(change[0]))
        held.append(batch)
    if held:
        yield joined()


def _candidates(batch: pa.RecordBatch, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that pass the length, positional and parity filters.

    Rows whose prefixes have the token before in common as well meet in its group. ``order`` is by
    group and size, if it is given; then a row looks no further than its size allows.
    """
    g, k, meta, sig, more, before = (batch.column(i).to_numpy() for i in range(6))
    at = np.arange(batch.num_rows) if order is None else order
    g, k, sig, more, before = g[at], k[at], sig[at].view(np.uint64), more[at].view(np.uint64), before[at]
    size, pos, side = meta[at] >> 32, (meta[at] & 0xFFFFFFFF) >> 2, meta[at] & 3
    i, step = np.arange(batch.num_rows), 0
    while len(i):
        step += 1
        i = i[:np.searchsorted(i, batch.num_rows - step)]
        j = i + step
        go = g[i] == g[j]
        if order is not None:
            go &= size[j] * NUM <= size[i] * DEN
        i = i[go]
        j = i + step
        both = size[i] + size[j]
        need = (both * NUM + NUM + DEN - 1) // (NUM + DEN)
        most = both - 2 * need
        ok = np.flatnonzero(np.bitwise_count(sig[i] ^ sig[j]) <= most)
        ok = ok[np.bitwise_count(sig[i[ok]] ^ sig[j[ok]]) + np.bitwise_count(more[i[ok]] ^ more[j[ok]]) <= most[ok]]
        x, y, need = i[ok], j[ok], need[ok]
        ok = (k[x] != k[y]) & ((before[x] != before[y]) | (before[x] < 0)) & ((side[x] == 2) | (side[x] != side[y]))
        ok &= np.minimum(size[x] - pos[x], size[y] - pos[y]) >= need
        if ok.any():
            yield at[x[ok]], at[y[ok]]


def line_matches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The answers of ``_matches``, one row per row of ``docs``; see there for their meaning."""
    return _matches(docs, id_col, text).drop("text_key")


def _matches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, n_links, class_id, removed, and text_key,
    the SHA-256 of its text.

    A line is the set of its words, A-Z lower-cased; it matches another line if their Jaccard similarity
    is 0.8 or more. A line goes if an earlier one, by doc_id and then line number, matches it, whether
    that one stays or not. ``removed`` lists line>doc:line, the earliest match, by line number from 0;
    ``n_links`` counts the different sets of words that the document's lines match besides their own;
    ``class_id`` is the smallest id that holds a match of any of its lines, its own included.

    Sets are the nodes of the join, so copies of a line are one. Tokens are ordered by a count sketch of
    fixed size, any consistent order being right; tokens whose bucket was counted once meet nobody and are
    left out of the index. The sets that hold a token in their prefix form its group; a large group is cut into
    blocks, and every two blocks meet. Length, positional and parity filters leave the sets that have a
    candidate in a group whose token before is not common too; those alone are fetched whole, and a group verifies its pairs and gives each set's number
    of links and earliest match, so pairs are never rows. A pair counts in the group of its first common token. Sets
    are known by 64-bit hashes. Lines without words stay. Null texts have one empty line; null ids come
    first; rows that share an id are one document for matches; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))
    texts = rows.select("text")
    counts = spark.sparkContext.broadcast(token_counts(texts).tobytes())

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(counts.value, np.uint32)
        for part, found in _slices(batches, 2):
            at, n = Lines(found, sketch), len(found)
            index = pa.array(np.concatenate([np.arange(n), at.text]))
            own = pa.nulls(len(at.text), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(index), part.column(1).take(index),
                 pa.array(np.concatenate([np.full(n, -1), at.number]).astype(np.int32)),
                 pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(at.key)]),
                 pa.array(np.concatenate([[t.count(b"\n") + 1 for t in found], at.size]).astype(np.int64)),
                 pa.concat_arrays([pa.array([hashlib.sha256(t).hexdigest() for t in found], pa.string()), own])],
                names=["doc_id", "row", "line", "k", "size", "text_key"])

    numbered = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    schema = rows.select("doc_id").withColumns({
        "row": F.lit(0).cast("long"), "line": F.lit(None).cast("int"), "k": F.lit(None).cast("long"), "size": F.lit(None).cast("long"),
        "text_key": F.lit(None).cast("string")}).schema
    table = cut_lineage(numbered.mapInArrow(lines, schema), "lines")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, done = np.frombuffer(counts.value, np.uint32), set()
        for _, found in _slices(batches, 0):
            at = Lines(found, sketch)
            sent = _unsent(at.key, done)
            n = at.size[sent]
            which, place = _ragged(at.start[sent], n - (NUM * n + DEN - 1) // DEN + 1)
            useful = at.seen[place] > 1
            which, place = which[useful], place[useful]
            before = np.where(np.diff(which, prepend=-1) == 0, np.roll(at.tokens[place].view(np.int64), 1), -1)
            line, pos, seen = sent[which], place - at.start[sent[which]], at.seen[place]
            t, k, sig, more = at.tokens[place], at.key[line], *(half[line] for half in at.parity)
            which, other = _ragged(np.zeros(len(t), np.int64), _blocks(seen))
            block = k[which] % _blocks(seen[which])
            side = np.where(block == other, 2, block > other)
            meta = (at.size[line][which] << 32) | (pos[which] << 2) | side
            group = _group(t[which], seen[which], block, other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (group, k[which], meta, sig[which], more[which], before[which])],
                names=["g", "k", "meta", "sig", "more", "before"])

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            met = np.zeros(batch.num_rows, dtype=bool)
            group = np.cumsum(np.diff(batch.column(0).to_numpy(), prepend=0) != 0)
            for i, j in _candidates(batch, np.argsort((group << 32) | (batch.column(2).to_numpy() >> 32))):
                met[i] = met[j] = True
            yield batch.filter(pa.array(met))

    posting = "g long, k long, meta long, sig long, more long, before long"
    postings = texts.mapInArrow(index, posting).repartition("g").sortWithinPartitions("g")
    members = cut_lineage(postings.mapInArrow(live, posting).distinct(), "members")
    wanted = spark.sparkContext.broadcast(bitmap_bytes(bitmap_of(members.select("k"), "k")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, done = np.frombuffer(counts.value, np.uint32), set()
        bits = np.frombuffer(wanted.value, np.uint8)
        for _, found in _slices(batches, 0):
            at = Lines(found, sketch)
            place = at.key % (len(bits) * 8)
            hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            hit = hit[_unsent(at.key[hit], done)]
            tokens = at.tokens[at.places(hit)[1]].view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(at.size[hit])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at.key[hit]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], names=["k", "v"])

    order = F.struct("doc_id", "line")
    first = cut_lineage(table.where("line >= 0").groupBy("k").agg(F.min(order).alias("first"), F.count("*").alias("n")), "first-lines")
    whole = texts.mapInArrow(sets, "k long, v array<long>").groupBy("k").agg(F.first("v").alias("v"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(counts.value, np.uint32)
        for batch in _whole_groups(batches):
            lists, group, k = batch.column(6), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            start = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            names, tokens = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            held = np.repeat(np.arange(len(size)), size) * len(names) + tokens  # ascending: rows, then a row's tokens
            seen = sketch[(names & ((1 << _HASH_BITS) - 1)) % BUCKETS]
            links, theirs = np.zeros(len(size), np.int64), np.full(len(size), len(size))
            for left, right in _candidates(batch):
                cuts = np.flatnonzero(np.diff((np.cumsum(size[left]) - 1) // _AT_ONCE, prepend=0))
                for i, j in zip(np.split(left, cuts), np.split(right, cuts)):
                    if not len(i):
                        continue
                    which, place = _ragged(start[i], size[i])
                    asked = j[which] * len(names) + tokens[place]
                    hit = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
                    begin = np.cumsum(size[i]) - size[i]
                    shared = np.add.reduceat(hit.astype(np.int64), begin)
                    earliest = np.minimum.reduceat(np.where(hit, tokens[place], len(names)), begin)
                    ok = shared * (NUM + DEN) >= (size[i] + size[j]) * NUM
                    i, j, earliest = i[ok], j[ok], earliest[ok]
                    blocks = _blocks(seen[earliest])
                    ok = _group(names[earliest], seen[earliest], k[i] % blocks, k[j] % blocks) == group[i]
                    i, j = i[ok], j[ok]
                    for x, y in ((i, j), (j, i)):
                        links += np.bincount(x, minlength=len(size))
                        np.minimum.at(theirs, x, y)  # rows are sorted by the place of their first line
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(some)), pa.array(links[some]), batch.column(7).take(pa.array(theirs[some]))], names=["k", "links", "theirs"])

    linked_schema = first.select("k", F.col("k").alias("links"), F.col("first").alias("theirs")).schema
    groups = members.join(whole, "k").join(first.select("k", "first"), "k").select("g", "k", "meta", "sig", "more", "before", "v", "first")
    linked = (
        groups.repartition("g").sortWithinPartitions("g", "first").mapInArrow(verify, linked_schema)
        .groupBy("k").agg(F.min("theirs").alias("theirs"), F.sum("links").alias("links")))
    known = cut_lineage(
        first.join(linked, "k", "left").where("n > 1 OR links > 0").select(
            "k", F.coalesce("links", F.lit(0)).alias("links"), F.least("first", F.coalesce("theirs", "first")).alias("match")), "matches")
    hit = table.where("line >= 0").join(known, "k").select("row", "line", "links", "match", (order > F.col("match")).alias("goes"))
    place = F.concat(F.col("line"), F.lit(">"), F.coalesce(F.col("match.doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("match.line"))
    by_row = hit.groupBy("row").agg(
        F.count_if("goes").alias("n_removed"), F.sum("links").alias("n_links"), F.min("match.doc_id").alias("least"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("goes"), F.struct("line", place.alias("p"))))), lambda s: s["p"]), ",").alias("removed"))
    return table.where("line < 0").select("doc_id", "row", "text_key", F.col("size").alias("n_lines")).join(by_row, "row", "left").select(
        "doc_id", "text_key", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.least("doc_id", F.coalesce("least", "doc_id")).alias("class_id"),
        F.coalesce("removed", F.lit("")).alias("removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with the removed lines taken out of the row they stand in; rows equal in id and text give one row."""
    found = _matches(docs, id_col, text).where("n_removed > 0").groupBy("doc_id", "text_key").agg(F.max("removed").alias("removed"))
    gone = F.transform(F.split("removed", ","), lambda p: F.split(p, ">")[0].cast("int"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(f"`{text}`").alias("text")).distinct().withColumn("text_key", F.sha2("text", 256))
    numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda s: ~F.array_contains("gone", s["i"])), lambda s: s["line"]), "\n")
    cut = found.select(F.col("doc_id").alias("found"), F.col("text_key").alias("found_key"), gone.alias("gone"))
    joined = rows.join(cut, (F.col("text_key") == F.col("found_key")) & F.col("doc_id").eqNullSafe(F.col("found")), "left")
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
