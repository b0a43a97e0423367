"""Cross-tokenizer alignment: byte-range fragments of two token streams, composed by an associative rule."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.llm.common import ship, text_or_empty
from recordflow.runtime import cut_lineage

ship(__name__)

RANGE = 1 << 16        # bytes of a range; longer texts are cut into several
MARGIN = 1 << 10       # how far a cut looks for a blank on either side; a range without one goes on
SLICE = 1 << 20        # bytes of short texts whose words are encoded together
PACK = 1 << 11         # bytes of words that are encoded as one stretch
FAN_IN = 16            # neighbours that one step of the reduction composes
FREQUENT = 1 << 18     # pairs that hold this part of all links or more are told by a table of as many rows at most

# A blank before which both tokenizers end a token: it stands alone between two printed characters. Bytes
# of two-byte letters, and of longer characters outside the blocks that hold white space, count as printed.
_PRINTED = rb"[!-~\xc3-\xdf\xe4-\xed\xf0-\xf4]"
_CUT = re.compile(
    rb"(?:[!-~]|[\xc3-\xdf][\x80-\xbf]|[\xe4-\xed][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}) (?=" + _PRINTED + rb")")


class Pair:
    """Both tokenizers with the bytes of their tokens; A is a byte-level BPE, B a piece model."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        vocab = self.a.get_vocab()
        plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(len(self.b))]
        self.sizes_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.names = np.array([str(i) for i in (*range(len(self.bytes_a)), *range(len(self.bytes_b)))], object)

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of A and of B and whether both give the text's bytes; each text starts with a blank."""
        plain = [t.decode() for t in texts]
        ids_a = [e.ids for e in self.a.encode_batch_fast(plain, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in plain], num_threads=1)
        a, b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        return ids_a, ids_b, [b"".join(map(a, x)) == t == b"".join(map(b, y)) for t, x, y in zip(texts, ids_a, ids_b)]


def check_pair(spec: str, model: bytes) -> int:
    """The number of ids of B; raises unless a blank between printed characters starts a token for both."""
    import sentencepiece

    parts = json.loads(spec)
    split = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        raise ValueError("the first tokenizer must be a byte-level BPE with the usual splitting")
    b = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any("▁" in b.id_to_piece(i).lstrip("▁") for i in range(len(b))):
        raise ValueError("a piece of the second tokenizer goes on after a blank")
    return len(b)


def ranges(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Byte ranges of a long text as (start of its words, start, end, end of its words).

    A range ends at a multiple of ``RANGE``, in the middle of a word or not. The stretch to encode reaches
    from the blank before its start to the blank after its end. Where no blank is near, the range goes on.
    """
    start = words = 0
    for end in range(RANGE, len(data), RANGE):
        window = max(start, end - MARGIN)
        cuts = [m.end() - 1 for m in _CUT.finditer(data, window, end + MARGIN)]
        before, after = [c for c in cuts if words < c <= end], [c for c in cuts if c >= end]
        if before and after:
            yield words, start, end, after[0]
            start, words = end, before[-1]
    yield words, start, len(data), len(data)


def shared_ends(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ends of A, ends of B, places in A and in B of the tokens that end together)."""
    ends_a, ends_b = np.cumsum(pair.sizes_a[a]), np.cumsum(pair.sizes_b[b])
    at = np.minimum(np.searchsorted(ends_a, ends_b), max(len(ends_a) - 1, 0))
    hit = ends_a[at] == ends_b if len(ends_a) else np.zeros(len(ends_b), bool)
    return ends_a, ends_b, at[hit], np.flatnonzero(hit)


def written(pair: Pair, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, breaks: np.ndarray) -> list[str]:
    """The groups ``a1,a2|b1;a3|b2`` as texts, a new one beginning after each group of ``breaks``.

    ``at_a`` and ``at_b`` name the last token of each group; all tokens belong to a group.
    """
    if not len(at_a):
        return []
    key = np.r_[2 * np.searchsorted(at_a, np.arange(len(a))), 2 * np.searchsorted(at_b, np.arange(len(b))) + 1]
    order = np.argsort(key, kind="stable")
    key, ids = key[order], np.r_[a, len(pair.bytes_a) + b][order]
    last = np.r_[key[1:] != key[:-1], True]
    mark = np.where(~last, ",", np.where(key % 2 == 0, "|", ";")).astype(object)
    final = np.flatnonzero(last & (key % 2 == 1))[breaks]
    mark[final] = "\n"
    mark[-1] = ""
    mixed = np.empty(2 * len(ids), object)
    mixed[0::2], mixed[1::2] = pair.names[ids], mark
    return "".join(mixed.tolist()).split("\n")


_KINDS = {
    "boolean": (T.BooleanType(), pa.bool_()), "long": (T.LongType(), pa.int64()), "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()), "ints": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "longs": (T.ArrayType(T.LongType()), pa.list_(pa.int64()))}


def fields(listed: str) -> tuple[list[T.StructField], pa.Schema]:
    """Spark's and Arrow's form of a list of names and kinds."""
    pairs = [f.split() for f in listed.split(",")]
    return [T.StructField(n, _KINDS[k][0]) for n, k in pairs], pa.schema([(n, _KINDS[k][1]) for n, k in pairs])


_SHORT = "ok boolean, n_a long, n_b long, n_groups long, groups string, keys longs, counts ints"
_PART = ("ok boolean, n_a long, n_b long, n_groups long, pre_a ints, pre_b ints, suf_a ints, suf_b ints, groups string, "
         "keys longs, counts ints")
_CHUNK = "at long, low long, high long, data binary"
_FRAGMENT = "row long, at long, first long, pre_a ints, pre_b ints, suf_a ints, suf_b ints, text string"


def _arrow(batch: pa.RecordBatch, keep: int, index: list[int], found: list[tuple], listed: str) -> pa.RecordBatch:
    """The first ``keep`` columns of the rows of ``index``, and the found values beside them."""
    schema = fields(listed)[1]
    rows = pa.array(index, pa.int64())
    columns = [pa.array([f[i] for f in found], s.type) for i, s in enumerate(schema)]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(i).take(rows) for i in range(keep)], *columns], names=[*batch.schema.names[:keep], *schema.names])


def words_of(data: bytes) -> list[bytes]:
    """A text in stretches that start at its cuts; both tokenizers end a token with each."""
    cuts = [0, *[m.end() - 1 for m in _CUT.finditer(data)], len(data)]
    return [data[i:j] for i, j in zip(cuts, cuts[1:])]


def _packed(words: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
    """Words by number in packs that are encoded as one stretch, and the others alone.

    A word between two printed ASCII characters may stand beside another such word: both tokenizers end
    a token where they meet.
    """
    packs, alone, now, size = [], [], [], 0
    for i, w in enumerate(words):
        if len(w) > 1 and 32 < w[1] < 127 and 32 < w[-1] < 127:
            now.append(i)
            size += len(w)
            if size >= PACK:
                packs.append(now)
                now, size = [], 0
        else:
            alone.append([i])
    return packs + ([now] if now else []), alone


def align_words(pair: Pair, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(good or not, numbers of A, B and groups, groups as written, where links start, link keys) of words."""
    good, sizes, groups = np.zeros(len(words), bool), np.zeros((3, len(words)), np.int64), [""] * len(words)
    starts = np.zeros(len(words), np.int64)
    packs, alone = _packed(words)
    units, held_a, held_b = [], [], []

    def encode(these: list[list[int]]) -> list[list[int]]:
        """Encode stretches; those whose tokens do not give their bytes come back."""
        ids_a, ids_b, same = pair.encode([b"".join([words[i] for i in u]) for u in these]) if these else ([], [], [])
        for u, x, y, s in zip(these, ids_a, ids_b, same):
            if s:
                units.append(u)
                held_a.append(np.array(x, np.int32))
                held_b.append(np.array(y, np.int32))
        return [u for u, s in zip(these, same) if not s]

    encode(alone + [[i] for u in encode(packs) for i in u])
    if not units:
        return good, sizes, groups, starts, np.zeros(0, np.int64)
    # words lie end to end; both token streams end with each of them, so no group crosses a border
    order = [i for u in units for i in u]
    a, b = np.concatenate(held_a).astype(np.int64), np.concatenate(held_b).astype(np.int64)
    ends_a, ends_b, at_a, at_b = shared_ends(pair, a, b)
    stops = np.cumsum([len(words[i]) for i in order])
    borders = np.searchsorted(ends_a[at_a], stops)
    good[order] = True
    sizes[0][order] = np.diff(np.r_[0, np.searchsorted(ends_a, stops, "right")])
    sizes[1][order] = np.diff(np.r_[0, np.searchsorted(ends_b, stops, "right")])
    sizes[2][order] = np.diff(np.r_[-1, borders])
    starts[order] = np.r_[0, borders[:-1] + 1]
    for i, text in zip(order, written(pair, a, b, at_a, at_b, borders)):
        groups[i] = text
    return good, sizes, groups, starts, a[at_a] * len(pair.bytes_b) + b[at_b]


def align_texts(pair: Pair, texts: list[bytes]) -> list[tuple]:
    """Rows of ``_SHORT`` for texts that start with a blank; texts of a blank alone have no tokens.

    Stretches that texts share are aligned once; their closed fragments follow one another in each text.
    """
    found = [(True, 0, 0, 0, "", [], [])] * len(texts)
    some = [i for i, t in enumerate(texts) if len(t) > 1]
    if not some:
        return found
    known: dict[bytes, int] = {}
    of = [[known.setdefault(w, len(known)) for w in words_of(texts[i])] for i in some]
    good, sizes, groups, starts, keys = align_words(pair, list(known))
    for i, words in zip(some, of):
        at = np.array(words, np.int64)
        if not good[at].all():
            continue
        n_a, n_b, n_groups = sizes[:, at].sum(axis=1).tolist()
        lengths = sizes[2][at]
        place = np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(n_groups)
        held, counts = np.unique(keys[place], return_counts=True)
        found[i] = (True, n_a, n_b, n_groups, ";".join([groups[w] for w in words]), held, counts)
    return found


def align_part(pair: Pair, data: bytes, low: int, high: int) -> tuple:
    """A row of ``_PART``: the fragment of the tokens that end in (low, high] of a stretch.

    The open prefix holds the tokens up to the first shared end, the open suffix those after the last; the
    groups between are closed. Without a shared end all tokens are prefix.
    """
    ids_a, ids_b, same = pair.encode([data])
    if not same[0]:
        return (False, 0, 0, 0, [], [], [], [], "", [], [])
    a, b = np.array(ids_a[0], np.int64), np.array(ids_b[0], np.int64)
    ends_a, ends_b = np.cumsum(pair.sizes_a[a]), np.cumsum(pair.sizes_b[b])
    a, b = a[(ends_a > low) & (ends_a <= high)], b[(ends_b > low) & (ends_b <= high)]
    ends_a, ends_b = ends_a[(ends_a > low) & (ends_a <= high)], ends_b[(ends_b > low) & (ends_b <= high)]
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    at_a, at_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
    if not len(both):
        return (True, len(a), len(b), 0, a, b, [], [], "", [], [])
    first_a, first_b, last_a, last_b = at_a[0] + 1, at_b[0] + 1, at_a[-1] + 1, at_b[-1] + 1
    inner = written(pair, a[first_a:last_a], b[first_b:last_b], at_a[1:] - first_a, at_b[1:] - first_b, np.array([], np.int64))
    keys, counts = np.unique(a[at_a] * len(pair.bytes_b) + b[at_b], return_counts=True)
    return (True, len(a), len(b), len(both), a[:first_a], b[:first_b], a[last_a:], b[last_b:], inner[0] if inner else "", keys, counts)


def compose(parts: list[dict]) -> tuple[dict, list[tuple[int, str]]]:
    """One fragment from neighbours in order, and the groups closed between them as (part they precede, text).

    A fragment is (first part with a shared end or none, prefix, suffix). An open suffix and the next open
    prefix close one group; a fragment without a shared end lengthens what is open. This is associative,
    so neighbours may be composed in any bracketing.
    """
    now = {"first": None, "pre_a": [], "pre_b": [], "suf_a": [], "suf_b": []}
    closed = []
    for part in parts:
        side = "pre" if now["first"] is None else "suf"
        open_a, open_b = now[f"{side}_a"] + part["pre_a"], now[f"{side}_b"] + part["pre_b"]
        if part["first"] is not None:
            if side == "suf":
                closed.append((part["first"], f"{','.join(map(str, open_a))}|{','.join(map(str, open_b))}"))
            else:
                now.update(first=part["first"], pre_a=open_a, pre_b=open_b)
            now.update(suf_a=part["suf_a"], suf_b=part["suf_b"])
        else:
            now.update({f"{side}_a": open_a, f"{side}_b": open_b})
    return now, closed


def reduce_parts(parts: DataFrame) -> DataFrame:
    """(row, at, text): the groups that lie across parts, each before the inner groups of part ``at``.

    Fragments of a text are composed ``FAN_IN`` neighbours at a time; every level is a shuffle of
    prefixes and suffixes alone and is stored. The number of levels is the logarithm of the longest text.
    """
    level = parts.select(
        "row", "at", F.when(F.col("n_groups") > 0, F.col("at")).alias("first"), "pre_a", "pre_b", "suf_a", "suf_b")
    schema, kinds = fields(_FRAGMENT)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, at, neighbours in zip(*[c.to_pylist() for c in batch.columns]):
                whole, closed = compose(neighbours)
                out.append({"row": row, "at": at, "text": None, **whole})
                out += [{"row": row, "at": before, "text": text} for before, text in closed]
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    across = []
    most = parts.agg(F.max("at")).first()[0] or 0
    while True:
        neighbours = F.sort_array(F.collect_list(F.struct("at", "first", "pre_a", "pre_b", "suf_a", "suf_b")))
        done = cut_lineage(
            level.groupBy("row", F.floor(F.col("at") / FAN_IN).alias("at")).agg(neighbours.alias("parts")).mapInArrow(up, T.StructType(schema)), "fragments")
        across.append(done.where("text is not null").select("row", "at", "text"))
        level = done.where("text is null").drop("text")
        most //= FAN_IN
        if not most:
            break
    start = F.concat(F.array_join("pre_a", ","), F.lit("|"), F.array_join("pre_b", ","))
    across.append(level.where("first is not null").select("row", F.col("first").alias("at"), start.alias("text")))
    found = across[0]
    for more in across[1:]:
        found = found.unionByName(more)
    return found


class Alignment:
    """The alignment of a table's texts: ``texts`` (a row per row), ``pieces`` of long texts, ``links``."""

    def __init__(self, docs: DataFrame, spec: str, model: bytes, id_col: str = "doc_id", text: str = "text"):
        self.n_b = check_pair(spec, model)
        spark = docs.sparkSession
        known = spark.sparkContext.broadcast((spec, model))
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))
        is_long = F.octet_length("text") >= RANGE
        # rows of the two kinds number themselves apart
        short = rows.where(~is_long).withColumn("row", F.col("row") * 2)
        long = rows.where(is_long).withColumn("row", F.col("row") * 2 + 1)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = Pair(*known.value)
            for batch in batches:
                texts = batch.column(2).cast(pa.binary())
                index, part, size = [], [], 0
                for n, value in enumerate(texts):
                    part.append(b" " + value.as_py())
                    index.append(n)
                    size += len(part[-1])
                    if size >= SLICE or len(part) >= 4_096:
                        yield _arrow(batch, 2, index, align_texts(pair, part), _SHORT)
                        index, part, size = [], [], 0
                if part:
                    yield _arrow(batch, 2, index, align_texts(pair, part), _SHORT)

        head = [rows.schema["row"], rows.schema["doc_id"]]
        self.short = short.mapInArrow(whole, T.StructType([*head, *fields(_SHORT)[0]]))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, value in enumerate(batch.column(2).cast(pa.binary())):
                    data = b" " + value.as_py()
                    found = [(at, start - words, end - words, data[words:stop]) for at, (words, start, end, stop) in enumerate(ranges(data))]
                    for i in range(0, len(found), 64):
                        part = found[i:i + 64]
                        yield _arrow(batch, 2, [n] * len(part), part, _CHUNK)

        def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = Pair(*known.value)
            for batch in batches:
                parts = zip(*[batch.column(i) for i in (3, 4, 5)])
                for n, (low, high, data) in enumerate(parts):
                    yield _arrow(batch, 3, [n], [align_part(pair, data.as_py(), low.as_py(), high.as_py())], _PART)

        chunks = long.mapInArrow(cut, T.StructType([*head, *fields(_CHUNK)[0]])).repartition("row", "at")
        self.parts = cut_lineage(chunks.mapInArrow(fragments, T.StructType([*head, fields(_CHUNK)[0][0], *fields(_PART)[0]])), "parts")
        self.bad = self.parts.where("NOT ok").select("row").distinct()
        self.sound = self.parts.join(self.bad, "row", "left_anti")

    def pieces(self) -> DataFrame:
        """(row, at, kind, text) of long texts: their groups are the texts by (at, kind), joined by ``;``."""
        across = reduce_parts(self.sound)
        return across.select("row", "at", F.lit(0).alias("kind"), "text").unionByName(
            self.sound.where("groups <> ''").select("row", "at", F.lit(1).alias("kind"), F.col("groups").alias("text")))

    def groups(self) -> DataFrame:
        """(row, doc_id, at, kind, text): every text's groups as written, in one piece or, of long texts, in several."""
        ids = self.sound.where("at = 0").select("row", "doc_id")
        return self.short.where("n_groups > 0").select("row", "doc_id", F.lit(0).cast("long").alias("at"), F.lit(1).alias("kind"), F.col("groups").alias("text")).unionByName(
            self.pieces().join(ids, "row").select("row", "doc_id", "at", "kind", "text"))


def _streamed_hash(pieces: DataFrame) -> DataFrame:
    """(row, groups_sha256): the pieces of a row are hashed one after the other as they stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0), batch.column(1)):
                row, text = row.as_py(), text.as_py().encode()
                if row != now:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = row, hashlib.sha256(text)
                else:
                    sha.update(b";" + text)
            yield done(out)
        yield done([(now, sha.hexdigest())] if sha else [])

    def done(out):
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["row", "groups_sha256"])

    return pieces.repartition("row").sortWithinPartitions("row", "at", "kind").select("row", "text").mapInArrow(run, "row long, groups_sha256 string")


def alignment(docs: DataFrame, spec: str, model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``spec`` is A's JSON, ``model`` B's bytes. Texts shorter than ``RANGE`` are one fragment. Longer ones are
    cut into byte ranges that are dealt to all tasks; a range knows its closed groups and links, and
    ``reduce_parts`` closes the groups across ranges. Links are counted per text before they move; of
    the corpus counts only those of frequent pairs (``FREQUENT`` rows at most) and of B's ids are broadcast,
    the other links meet their count by a join on the pair, in which no key can be hot. Null and empty
    texts, and texts whose tokens do not give their bytes, have zeros and an empty digest; repeated rows
    and ids, null ones too, give a row each; other columns are ignored; an empty table gives no rows.
    """
    aligned = Alignment(docs, spec, model, id_col, text)
    n_b = aligned.n_b
    sums = ["n_a", "n_b", "n_groups"]
    short = cut_lineage(aligned.short.withColumn(
        "groups_sha256", F.when(F.col("n_groups") > 0, F.sha2(F.col("groups"), 256)).otherwise("")).drop("groups", "ok"), "aligned")
    per_row = aligned.parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *[F.when(F.bool_and("ok"), F.sum(c)).otherwise(0).alias(c) for c in sums])
    long = per_row.join(_streamed_hash(aligned.pieces()), "row", "left").withColumn("groups_sha256", F.coalesce("groups_sha256", F.lit("")))

    held = short.select("row", "keys", "counts").unionByName(aligned.sound.select("row", "keys", "counts"))
    links = held.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("z")).select(
        "row", F.col("z.keys").alias("key"), F.col("z.counts").cast("long").alias("n"))
    counted = cut_lineage(links.groupBy("key").agg(F.sum("n").alias("count")), "pair-counts")
    # at most one row per id of B
    best = counted.groupBy((F.col("key") % n_b).alias("id_b")).agg(F.max("count").alias("most"))
    ranked = cut_lineage(counted.join(F.broadcast(best), F.col("key") % n_b == F.col("id_b")).select(
        "key", "count", (F.col("count") == F.col("most")).alias("is_best")), "ranked-pairs")
    total = ranked.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * FREQUENT >= total  # so many links hold a frequent pair that there are FREQUENT at most
    frequent, rare = ranked.where(often), ranked.where(~often)

    def scored(rows: DataFrame) -> DataFrame:
        return rows.groupBy("row").agg(
            F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))

    common = links.join(F.broadcast(frequent), "key")
    others = links.join(F.broadcast(frequent.select("key")), "key", "left_anti").join(rare.hint("merge"), "key")
    scores = scored(common).unionByName(scored(others)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    columns = ["row", "doc_id", *sums, "groups_sha256"]
    return short.select(*columns).unionByName(long.select(*columns)).join(scores, "row", "left").select(
        "doc_id", *sums, F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
