"""BPE encoding and decoding with content-defined chunks: shared chunks are encoded once, joins are repaired."""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.llm.common import bitmap_bytes, bitmap_of, ship, text_or_empty
from recordflow.runtime import cut_lineage

ship(__name__)

MEAN_BITS = 10          # a chunk ends where so many bits of the rolling hash are zero: 1 KiB on average
SHORTEST, LONGEST = 256, 8_192
MEMO_BYTES = 64 << 20   # of words and ids that a task remembers, objects included
LONG_WORD = 64          # bytes from which a word is not remembered
_OBJECTS = 200          # bytes that a remembered word takes besides its contents
_SLICE = 200            # texts whose words are encoded together
_MASK = (1 << 64) - 1
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 5) for b in range(256)], dtype=np.uint32)


def chunks(data: bytes) -> list[bytes]:
    """Cut where a rolling hash of the last 32 bytes says so; the same passage is cut alike in any document."""
    if len(data) <= SHORTEST:
        return [data] if data else []
    rolled = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint32(width)
        rolled = wider
    found, start = [], 0
    for cut in [*(np.flatnonzero(rolled >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist(), len(data)]:
        while cut - start > LONGEST:
            found.append(data[start:start + LONGEST])
            start += LONGEST
        if cut - start >= SHORTEST or (cut == len(data) and cut > start):
            found.append(data[start:cut])
            start = cut
    return found


def chunk_key(chunk: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(chunk)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (digest >> 64, digest & _MASK))


class Encoder:
    """A tokenizer with the ids of the words it has met.

    Words are runs of anything but ASCII white space. ``check_tokenizer`` has made sure that no token
    crosses white space, so a text's ids are those of its words one after the other, and that tokens
    are decoded as they are, with spaces between. Half of the memory is given up at a time: words that
    were met since the last time stay.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = np.full(max(names.values(), default=-1) + 1, b"", dtype=object)
        for name, i in names.items():
            self.tokens[i] = name.encode()
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    @staticmethod
    @contextmanager
    def of_task(spec: str) -> Iterator[Encoder]:
        """The worker's tokenizer, of fixed size, with a memory of words that ends with the task."""
        home = sys.modules.setdefault("_recordflow_encoders", types.ModuleType("_recordflow_encoders"))
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in home.__dict__:
            home.__dict__[key] = Encoder(spec)
        encoder = home.__dict__[key]
        try:
            yield encoder
        finally:
            encoder.forget()
            pa.default_memory_pool().release_unused()

    def _remember(self, word: bytes, ids: bytes) -> None:
        if self.held > MEMO_BYTES // 2:
            self.memo, self.older, self.held = {}, self.memo, 0
        self.memo[word] = ids
        self.held += _OBJECTS + len(word) + len(ids)

    def ids(self, texts: list[list[bytes]]) -> list[bytes]:
        """For each list of words its ids, as little-endian unsigned 32-bit integers.

        Every different word of the lists is looked up once, and the unknown ones are encoded together.
        """
        found: dict[bytes, bytes] = {}
        new = []
        for word in set().union(*texts):
            ids = self.memo.get(word)
            if ids is None:
                ids = self.older.get(word)
                if ids is None:
                    new.append(word)
                    continue
                self._remember(word, ids)
            found[word] = ids
        for at in range(0, len(new), 4_096):
            part = new[at:at + 4_096]
            for word, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                found[word] = ids = np.array(e.ids, dtype="<u4").tobytes()
                if len(word) < LONG_WORD:
                    self._remember(word, ids)
        return [b"".join(map(found.__getitem__, words)) for words in texts]

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8."""
        return b" ".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())


def check_tokenizer(spec: str) -> None:
    """Raise unless white space ends words for this tokenizer and decoding joins tokens by spaces."""
    parts = json.loads(spec)
    split = parts.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [split])
    drops = any(s.get("type") in ("Whitespace", "WhitespaceSplit") or (
        s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed" and r"\s" not in str(s["pattern"]).replace(r"[^\\s", "")) for s in steps)
    if not drops or parts.get("decoder") or parts.get("post_processor"):
        raise ValueError("the tokenizer must drop white space between words and join tokens by spaces")


def _piece(data: bytes) -> tuple[list[bytes], bytes, bytes, bool]:
    """(whole words, partial word at the start, partial word at the end, no white space at all)."""
    words = data.split()
    lead = words.pop(0) if words and not data[:1].isspace() else b""
    solid = not words and lead == data
    trail = words.pop() if words and not data[-1:].isspace() else b""
    return words, lead, trail, solid


def _digests(ids: bytes, text: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()


_PART = "at int, k1 long, k2 long, data binary, ids binary, lead binary, trail binary, solid boolean"
_DONE = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def encode_decode(docs: DataFrame, spec: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 of its whole text.

    ``spec`` is a tokenizer's JSON. Texts are cut into chunks where a rolling hash says so; the first
    pass counts chunk hashes. In the second pass a document all of whose chunks are its own is encoded
    in place; of the others the own parts are encoded in place and the shared chunks go out. Each
    shared chunk is encoded once, its ids are joined back, and where chunks meet the word that the cut
    runs through is encoded anew, over as many chunks as it spans, so that the ids are those of the
    whole text. Which chunks are shared is told by a bitmap of fixed size: where it is wrong, a chunk
    takes the longer way with the same result. Null and empty texts have no tokens; rows that repeat
    are encoded each; other columns are ignored; an empty table gives no rows.
    """
    check_tokenizer(spec)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chunk_key(c) for t in batch.column(0) for c in chunks(t.as_py().encode())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in found], pa.int64()) for i in (0, 1)], names=["k1", "k2"])

    seen = rows.select("text").mapInArrow(keys, "k1 long, k2 long")
    shared = seen.groupBy("k1", "k2").count().where("count > 1")
    bitmap = spark.sparkContext.broadcast(bitmap_bytes(bitmap_of(shared, "k1")))
    json_text = spark.sparkContext.broadcast(spec)
    part_schema = T._parse_datatype_string(f"row string, {_PART}, {_DONE}")
    out_schema = T.StructType([rows.schema["doc_id"], *part_schema])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Encoder.of_task(json_text.value) as encoder:
            bits, arrow = bitmap.value, _arrow(part_schema)
            for batch in batches:
                for start in range(0, batch.num_rows, _SLICE):
                    part = batch.slice(start, _SLICE)
                    index: list[int] = []
                    found: list[tuple] = []
                    words: list[list[bytes]] = []
                    for n, value in enumerate(part.column(1)):
                        data = value.as_py().encode()
                        cut = [(c, chunk_key(c)) for c in chunks(data)]
                        places = [k[0] % (len(bits) * 8) for _, k in cut]
                        alike = [bits[p >> 3] >> (p & 7) & 1 for p in places]
                        row = uuid.uuid4().hex
                        if not any(alike):
                            index.append(n)
                            found.append((row, -1))
                            words.append(data.split())
                            continue
                        own = b""
                        for (chunk, key), out in zip([*cut, (b"", None)], [*alike, True]):
                            if not out:
                                own += chunk
                                continue
                            if own:
                                whole_words, *ends = _piece(own)
                                index.append(n)
                                found.append((row, len(index), *ends))
                                words.append(whole_words)
                                own = b""
                            if key:
                                index.append(n)
                                found.append((row, len(index), *key, zlib.compress(chunk, 1), None, None, None, None, None, None, None))
                    encoded = iter(encoder.ids(words))
                    for at, f in enumerate(found):
                        if len(f) == 2:
                            ids = next(encoded)
                            found[at] = (*f, None, None, None, None, None, None, None, *_digests(ids, encoder.decode(ids)))
                        elif len(f) == 5:
                            found[at] = (*f[:2], None, None, None, zlib.compress(next(encoded), 1), *f[2:], None, None, None)
                    columns = [pa.array([f[i] for f in found], kind.type) for i, kind in enumerate(arrow)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(index, pa.int64())), *columns], names=["doc_id", *arrow.names])

    cut = cut_lineage(rows.mapInArrow(parts, out_schema), "chunks")
    done = cut.where("at < 0").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Encoder.of_task(json_text.value) as encoder:
            for batch in batches:
                for start in range(0, batch.num_rows, _SLICE):
                    part = batch.slice(start, _SLICE)
                    found = [_piece(zlib.decompress(d.as_py())) for d in part.column(2)]
                    ids = encoder.ids([f[0] for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array([zlib.compress(i, 1) for i in ids], pa.binary()),
                         pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary()),
                         pa.array([f[3] for f in found], pa.bool_())],
                        names=["k1", "k2", "ids", "lead", "trail", "solid"])

    sent = cut.where("k1 is not null")
    encoded = cut_lineage(
        sent.groupBy("k1", "k2").agg(F.first("data").alias("data"))
        .mapInArrow(once, "k1 long, k2 long, ids binary, lead binary, trail binary, solid boolean"), "encoded-chunks")
    place = ["row", "doc_id", "at"]
    joined = sent.select(*place, "k1", "k2").join(encoded, ["k1", "k2"]).drop("k1", "k2")
    pieces = joined.unionByName(cut.where("ids is not null").select(*place, "ids", "lead", "trail", "solid"))
    whole = pieces.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "ids", "lead", "trail", "solid"))).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Encoder.of_task(json_text.value) as encoder:
            for batch in batches:
                for start in range(0, batch.num_rows, _SLICE):
                    part = batch.slice(start, _SLICE)
                    texts, met = [], []  # a text's ids in pieces, None for a word that cuts ran through
                    for parts_ in part.column(1):
                        ids, carry = [], b""
                        for p in parts_.as_py():
                            carry += p["lead"]
                            if p["solid"]:
                                continue
                            if carry:
                                ids.append(None)
                                met.append([carry])
                            ids.append(p["ids"])
                            carry = p["trail"]
                        if carry:
                            ids.append(None)
                            met.append([carry])
                        texts.append(ids)
                    joints, found = iter(encoder.ids(met)), []
                    for ids in texts:
                        joined_ids = b"".join([next(joints) if i is None else zlib.decompress(i) for i in ids])
                        found.append(_digests(joined_ids, encoder.decode(joined_ids)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *[pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    result = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(_DONE)])
    return done.unionByName(whole.select("doc_id", "parts").mapInArrow(assemble, result))


def tokenizer_spec(path: str) -> str:
    """The tokenizer's JSON, read on the driver: a file of fixed size that is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()
