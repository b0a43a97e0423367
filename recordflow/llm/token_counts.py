"""Token counts by rank-synchronous merging: batches of words as ragged arrays, each word's lowest-rank pair at a time."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.llm.common import ship, text_or_empty

ship(__name__)

SLICE_BYTES = 4 << 20      # of text whose words are merged together; longer texts are taken in such parts
_NEVER = np.iinfo(np.int64).max
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class Merges:
    """A BPE vocabulary as arrays: the symbol of each character, and rank and result of each pair."""

    def __init__(self, spec: str):
        parts = json.loads(spec)
        model = parts["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or any(t[k] for t in parts["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"not a plain BPE tokenizer: {model.get('type')} {odd}")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        table = dict(zip(((left << 32) | right).tolist(), rank.tolist()))
        self.keys = np.array(sorted(table), np.int64)
        self.ranks = np.array([table[k] for k in sorted(table)], np.int64)
        self.result = result
        # If a pair with the result of merge r ranks before r, the occurrences of r are merged one by one.
        earliest = np.full(max(vocab.values()) + 1, _NEVER)
        np.minimum.at(earliest, left, rank)
        np.minimum.at(earliest, right, rank)
        self.single = earliest[result] < rank if len(pairs) else np.zeros(0, bool)
        inner = {ord(t): i for t, i in vocab.items() if len(t) == 1}
        last = {ord(t[0]): i for t, i in vocab.items() if len(t) == 1 + len(suffix) and t[1:] == suffix}
        size = max([*inner, *last]) + 1
        self.inner, self.last = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.inner[list(inner)], self.last[list(last)] = list(inner.values()), list(last.values())
        self.added = [(t["content"], t["normalized"]) for t in parts["added_tokens"]]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NEVER)
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def survivors(self, pieces: list[str]) -> np.ndarray:
        """How many symbols are left of each piece when no pair can be merged any more.

        All pieces lie in one array of symbols, with the rank of each symbol and its right neighbour.
        In a round every piece merges all occurrences of its lowest-rank pair, from the left; symbols
        taken in are squeezed out and ranks change only beside a merge. Finished pieces leave the array.
        """
        counts = np.zeros(len(pieces), np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not lengths.sum():
            return counts
        code = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), lengths)
        final = np.r_[piece[1:] != piece[:-1], True]
        code = np.minimum(code, len(self.inner) - 1)
        symbol = np.where(final, self.last[code], self.inner[code])
        if (symbol < 0).any():
            raise ValueError("the vocabulary lacks a character of the text")
        rank = np.full(len(symbol), _NEVER)
        inside = np.flatnonzero(~final)
        rank[inside] = self.rank_of(symbol[inside], symbol[inside + 1])
        while len(symbol):
            start = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            size = np.diff(np.r_[start, len(symbol)])
            best = np.minimum.reduceat(rank, start)
            done = best == _NEVER
            if done.any():
                counts[piece[start[done]]] = size[done]
                stay = np.repeat(~done, size)
                symbol, rank, piece = symbol[stay], rank[stay], piece[stay]
                best, size = best[~done], size[~done]
                if not len(symbol):
                    break
            lowest = np.repeat(best, size)
            hit = np.flatnonzero(rank == lowest)
            # of hits in a row, as in a run of one symbol, every other one is free
            fresh = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            first = np.r_[True, piece[hit[1:]] != piece[hit[:-1]]]
            hit = hit[((np.arange(len(hit)) - run) % 2 == 0) & (first | ~self.single[rank[hit]])]
            symbol[hit] = self.result[rank[hit]]
            gone = np.zeros(len(symbol), bool)
            gone[hit + 1] = True
            place = np.cumsum(~gone) - 1
            now = place[hit]
            symbol, rank, piece = symbol[~gone], rank[~gone], piece[~gone]
            touched = np.unique(np.r_[now, now[now > 0] - 1])
            rank[touched] = _NEVER
            touched = touched[touched + 1 < len(symbol)]
            touched = touched[piece[touched] == piece[touched + 1]]
            rank[touched] = self.rank_of(symbol[touched], symbol[touched + 1])
        return counts


class Counter:
    """Token counts of texts; the library normalises and splits, the merging is ``Merges``'."""

    def __init__(self, spec: str, merges: Merges, blanks_dropped: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        self.normalizer, self.splitter, self.merges = tokenizer.normalizer, tokenizer.pre_tokenizer, merges
        self.blanks_dropped = blanks_dropped
        raw, normal = ([c for c, n in merges.added if n is kind] for kind in (False, True))
        self.raw = self._pattern(raw)
        self.normal = self._pattern([self._normalised(c) for c in normal])

    @staticmethod
    def _pattern(contents: list[str]) -> re.Pattern | None:
        return re.compile("|".join(re.escape(c) for c in sorted(contents, key=len, reverse=True))) if contents else None

    def _normalised(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _split(self, text: str) -> tuple[int, list[str]]:
        """(added tokens in it, the normalised stretches between them)."""
        stretches = [text] if not (self.raw and self.raw.search(text)) else self.raw.split(text)
        found = len(stretches) - 1
        stretches = [self._normalised(s) for s in stretches if s]
        if self.normal:
            cut = [self.normal.split(s) for s in stretches]
            found += sum(len(c) - 1 for c in cut)
            stretches = [s for c in cut for s in c if s]
        return found, stretches

    def units(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit: a word where white space is dropped, else a whole text."""
        counts = np.zeros(len(units), np.int64)
        stretches, owner = [], []
        for n, unit in enumerate(units):
            found, parts = self._split(unit)
            counts[n] = found
            stretches += parts
            owner += [n] * len(parts)
        if self.blanks_dropped:
            # one call for all: a blank between two stretches is dropped and joins nothing
            starts = np.cumsum([0, *[len(s) + 1 for s in stretches]])
            found = self.splitter.pre_tokenize_str(" ".join(stretches)) if stretches else []
            of = np.searchsorted(starts, np.fromiter((f[1][0] for f in found), np.int64, len(found)), "right") - 1
            pieces = [f[0] for f in found]
        else:
            split = [[p for p, _ in self.splitter.pre_tokenize_str(s)] if self.splitter else [s] for s in stretches]
            of = np.repeat(np.arange(len(split)), [len(s) for s in split])
            pieces = [p for s in split for p in s]
        known: dict[str, int] = {}
        index = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
        left = self.merges.survivors(list(known))
        np.add.at(counts, np.array(owner, np.int64)[of], left[index])
        return counts

    def texts(self, texts: Iterator[bytes]) -> list[int]:
        """Tokens of each text, in order; slices of bounded size are counted together."""
        totals: list[int] = []
        waiting, size = [], 0
        for n, data in enumerate(texts):
            totals.append(0)
            for part in self._parts(data):
                waiting.append((n, part))
                size += len(part)
                if size >= SLICE_BYTES:
                    self._add(totals, waiting)
                    waiting, size = [], 0
        if waiting:
            self._add(totals, waiting)
        return totals

    def _parts(self, data: bytes) -> Iterator[bytes]:
        """A text in parts of about ``SLICE_BYTES`` cut at white space, or whole where white space counts."""
        at = 0
        while self.blanks_dropped and len(data) - at > SLICE_BYTES:
            cut = _BLANK.search(data, at + SLICE_BYTES)
            if cut is None:
                break
            yield data[at:cut.start()]
            at = cut.start()
        yield data[at:]

    def _add(self, totals: list[int], waiting: list[tuple[int, bytes]]) -> None:
        known: dict[bytes, int] = {}
        of, sizes = [], []
        for _, data in waiting:
            units = data.split() if self.blanks_dropped else [data]
            of += [known.setdefault(u, len(known)) for u in units]
            sizes.append(len(units))
        counts = self.units([u.decode() for u in known])
        ends = np.cumsum(sizes)
        sums = np.r_[0, np.cumsum(counts[np.array(of, np.int64)])]
        for (n, _), end, size in zip(waiting, ends, sizes):
            totals[n] += int(sums[end] - sums[end - size])


def drops_blanks(spec: str) -> bool:
    """Whether white space only ends words for this tokenizer, so that words can be counted one by one."""
    split = json.loads(spec).get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [split])
    return any(s.get("type") in ("Whitespace", "WhitespaceSplit") or (
        s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed"
        and r"\s" not in str(s["pattern"].get("Regex", r"\s")).replace(r"[^\s", "")) for s in steps)


def count_tokens(docs: DataFrame, spec: str, limit: int = 2_048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``spec`` is the JSON of a BPE tokenizer without dropout, unknown token or byte fallback. Added tokens
    inside texts count as one each, none are put around them, nothing is truncated or padded. A narrow
    pass in Arrow batches: tables of the vocabulary's size are broadcast, and a slice of ``SLICE_BYTES``
    of text is worked on at a time, so memory does not grow with a text as long as it has white space.
    Null and empty texts have 0 bytes and tokens; repeated rows and ids, null ones too, give a row each;
    other columns are ignored; an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    known = context.broadcast((spec, Merges(spec), drops_blanks(spec)))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*known.value)
        for batch in batches:
            data = batch.column(1).cast(pa.binary())
            tokens = counter.texts(d.as_py() for d in data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(data).cast(pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    counted = T._parse_datatype_string("n_bytes long, n_tokens long, over_limit boolean")
    return rows.mapInArrow(count, T.StructType([rows.schema["doc_id"], *counted]))
