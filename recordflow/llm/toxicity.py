"""Toxicity: a subsequence string kernel on words, Nyström landmarks, a linear SVM over sentences."""

from __future__ import annotations

import re
import sys
import types
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import by_text, crc_of, ship
from recordflow.llm.quality import labelled
from recordflow.runtime import cut_lineage

ship(__name__)

MAX_LABELLED = 20_000   # labelled rows a fit looks at, the first ones by hash of their id
LANDMARKS = 32          # at most
STEM = 8                # letters of a stem at most
ON = "-"                # after a landmark that is a stem, which is compared with how words begin
LESS = 0.9              # what a stem's score counts beside a whole word's
LEAST = 0.1             # by which a landmark tells the labels apart at least, rows met before counting less
_COUNTED, _RANKED = 50_000, 1_000  # fragments of toxic sample rows whose other rows are counted, and are looked up row by row
LENGTH = 3              # letters of a subsequence
DECAY = 0.6             # for each letter that a subsequence spans
FLOOR = 0.5             # similarities below count as none
POWER = 6
RARE = 0.01             # added to sums for each sentence before their logarithm
WINDOW = 48             # letters; longer words are taken in windows that overlap by half
_PARTS = 4               # partitions of the fit
MEMO_WORDS = 400_000    # words a worker remembers before it starts anew

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_NO_LETTER = re.compile(r"[^\w\s]+|[\d_]+")
_EDGE = ".,;:!?\"'()[]{}"  # what may stand around a word and is no part of it
_MARK = r"[^\w\s]|[\d_]"


def words_of(sentence: str) -> list[str]:
    """Words of a lower-cased sentence: letters only; three or more single letters in a row are one word."""
    words = _NO_LETTER.sub("", sentence).split()
    sizes = list(map(len, words))
    if sizes.count(1) >= 3:
        words = _joined(words)
    if sizes and max(sizes) > WINDOW:
        words = [v for w in words for v in _windows(w)]
    return words


def _joined(words: list[str]) -> list[str]:
    out, run = [], []
    for word in [*words, ""]:
        if len(word) == 1:
            run.append(word)
            continue
        out += ["".join(run)] if len(run) >= 3 else run
        run = []
        out.append(word)
    return out[:-1]


def _codes(words: list[str], width: int, blank: int) -> np.ndarray:
    codes = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int32)
    return np.where(codes == 0, np.int32(blank), codes)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted common subsequences of ``LENGTH`` letters, a value for each pair of rows of s and t.

    Rows are padded at the end by codes that equal nothing in the other array.
    """
    pairs, n, m = len(s), s.shape[1], t.shape[1]
    below = np.ones((n + 1, m + 1, pairs), dtype=np.float32)
    total = np.zeros(pairs, dtype=np.float32)
    same = (s.T[:, None, :] == t.T[None, :, :]).astype(np.float32) * np.float32(DECAY * DECAY)
    for level in range(1, LENGTH + 1):
        if level == LENGTH:
            return total + np.einsum("abp,abp->p", same, below[:-1, :-1])
        here = np.zeros_like(below)
        for a in range(1, n + 1):
            gain = same[a - 1] * below[a - 1, :-1]
            run = np.zeros(pairs, dtype=np.float32)
            for b in range(1, m + 1):
                run = np.float32(DECAY) * run + gain[b - 1]
                here[a, b] = np.float32(DECAY) * here[a - 1, b] + run
        below = here
    return total


def _self_kernel(words: list[str], width: int) -> np.ndarray:
    return subsequence_kernel(_codes(words, width, -1), _codes(words, width, -2))


def _letters(codes: np.ndarray) -> np.ndarray:
    """The letters of each row as bits; padding is below zero."""
    bits = np.where(codes < 0, np.uint64(0), np.uint64(1) << (codes % 61).astype(np.uint64))
    return np.bitwise_or.reduce(bits, axis=1)


@dataclass
class Similarity:
    """Normalised kernel values of words against the landmarks, powers of those from ``FLOOR`` on.

    A word is compared with a landmark only if it has three quarters of the landmark's letters; otherwise
    the value is zero. A disguised landmark, see ``disguised``, counts as the landmark itself.
    """

    landmarks: list[str]
    known: set[str] = field(default_factory=set)          # words met so far
    hot: dict[str, np.ndarray] = field(default_factory=dict)  # those of them with a value other than zero
    hidden: set[str] = field(default_factory=set)         # those of them that are or hide a landmark

    def __post_init__(self):
        self.bare = [w.rstrip(ON) for w in self.landmarks]
        self.width = max([LENGTH, *map(len, self.bare)])
        self.own = _self_kernel(self.bare, self.width) if self.landmarks else np.zeros(0)
        self.codes = _codes(self.bare, self.width, -2) if self.landmarks else np.zeros((0, self.width), np.int32)
        # Landmarks by the number of letters of a word they are compared with.
        self.reach: dict[int, list[int]] = {}
        for n, w in enumerate(self.landmarks):
            self.reach.setdefault(len(self.bare[n]) + 1 if w.endswith(ON) else WINDOW, []).append(n)
        self.whole = [n for n, w in enumerate(self.landmarks) if not w.endswith(ON)]
        self.letters = _letters(self.codes)
        self.needed = np.ceil(0.75 * np.bitwise_count(self.letters))
        self.plain = self.of(self.bare)
        spread = [".?".join(map(re.escape, self.bare[n])) for n in self.whole]
        marked = ["".join(f"(?:{re.escape(c)}|{_MARK})" for c in self.bare[n]) for n in self.whole]
        self.spread, self.marked = (re.compile("|".join(f"({p})" for p in ps) or "(?!)") for ps in (spread, marked))

    def __getstate__(self):
        return {"landmarks": self.landmarks}

    def __setstate__(self, state):
        self.landmarks, self.known, self.hot, self.hidden = state["landmarks"], set(), {}, set()
        self.__post_init__()

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each word; a stem is compared with the word's beginning, a letter longer than the stem."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        for reach, columns in self.reach.items():
            number: dict[str, int] = {}
            at = [number.setdefault(w[:reach], len(number)) for w in words]
            if at:
                out[:, columns] = self._of(list(number), np.array(columns))[at]
        return out

    def _of(self, words: list[str], columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), len(columns)), dtype=np.float32)
        landmarks, landmarks_own = self.codes[columns], self.own[columns]
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= LENGTH:
                buckets.setdefault(-(-len(w) // 6) * 6, []).append(i)
        for width, members in buckets.items():
            for at in range(0, len(members), 8_192):
                part = np.array(members[at:at + 8_192])
                chosen = [words[i] for i in part]
                codes = _codes(chosen, width, -1)
                meets = np.bitwise_count(_letters(codes)[:, None] & self.letters[None, columns]) >= self.needed[None, columns]
                row, column = np.nonzero(meets)
                if not len(row):
                    continue
                shared = np.concatenate([
                    subsequence_kernel(codes[row[start:start + 4_096]], landmarks[column[start:start + 4_096]])
                    for start in range(0, len(row), 4_096)])
                # A word's own kernel is at least that of its runs of LENGTH letters, so most pairs are known to be
                # below FLOOR without it.
                least = (np.array(list(map(len, chosen)), dtype=np.float32) - LENGTH + 1) * np.float32(DECAY ** (2 * LENGTH))
                may = shared >= 0.999 * FLOOR * np.sqrt(least[row] * landmarks_own[column])
                row, column, shared = row[may], column[may], shared[may]
                rows = np.unique(row)
                if not len(rows):
                    continue
                own = np.ones(len(chosen), dtype=np.float32)
                own[rows] = subsequence_kernel(codes[rows], np.where(codes[rows] < 0, np.int32(-2), codes[rows]))
                value = shared / np.sqrt(np.maximum(own[row] * landmarks_own[column], 1e-12))
                out[part[row], column] = np.where(value >= FLOOR, np.minimum(value, 1.0) ** POWER, 0.0)
        return out

    def disguised(self, word: str) -> np.ndarray | None:
        """The values of the landmark that a word hides, None if it hides none.

        All letters in order with at most one other character between two of them, or marks and digits
        in the place of letters, two letters and two fifths of them being left.
        """
        core = word.strip(_EDGE)
        hit = self.spread.fullmatch(core)
        if hit is None and not core.isalpha():
            hit = self.marked.fullmatch(core)
            if hit and sum(map(str.isalpha, core)) < max(2, 0.4 * len(core)):
                hit = None
        return None if hit is None else self.plain[self.whole[hit.lastindex - 1]]

    def learn(self, words: set[str]) -> None:
        """Meet words, with or without other characters than letters in them."""
        new = words - self.known
        if len(self.known) + len(new) > MEMO_WORDS:
            self.known, self.hot, self.hidden = set(), {}, set()
            new = words
        core = {w: w if w.isalpha() else _NO_LETTER.sub("", w) for w in new}
        bare = sorted(set(core.values()) - self.known)
        pieces = [(w, v) for w in bare for v in _windows(w)]
        values = self.of([v for _, v in pieces])
        for n in np.flatnonzero(values.any(axis=1)):
            self.hot[pieces[n][0]] = values[n].copy()
        for w in sorted(new | set(bare)):
            v = self.disguised(w)
            if v is not None:
                self.hot[w] = v
                self.hidden.add(w)
            elif w in core and core[w] in self.hot and core[w] not in self.hidden:
                self.hot[w] = self.hot[core[w]]
        for w, c in core.items():
            if c in self.hidden and w not in self.hidden:
                self.hot[w] = self.of([c[:WINDOW]])[0]
        self.known |= new
        self.known.update(bare)

    def sentence(self, words: list[str]) -> np.ndarray | None:
        """The sum over a sentence's words, None if all are zero; ``learn`` has met the words."""
        hits = [v for v in map(self.hot.get, words) if v is not None]
        return np.sum(hits, axis=0, dtype=np.float64) if hits else None

    def sums(self, text: str) -> list[np.ndarray]:
        """``sentence`` of every sentence of a text, without those that are None."""
        lowered = text.lower().split()
        spaced = [len(w) == 1 or (len(w) == 2 and not w.isalpha()) for w in lowered]
        met = set(lowered)
        self.learn(met)
        if self.hot.keys().isdisjoint(met) and not _three_running(spaced):
            return []
        split = _SENTENCE.split(text.lower())
        words = list(map(words_of, split))
        self.learn({w for s in words for w in s} | met)
        for found, sentence in zip(words, split):
            # Words that only their marks and digits give away.
            found += [w for w in sentence.split() if w in self.hidden and _NO_LETTER.sub("", w) not in self.hidden]
        return [v for v in map(self.sentence, words) if v is not None]


def _three_running(flags: list[bool]) -> bool:
    return b"\x01\x01\x01" in bytes(flags)


def _windows(word: str) -> list[str]:
    return [word] if len(word) <= WINDOW else [word[i:i + WINDOW] for i in range(0, len(word), WINDOW // 2)]


@dataclass(frozen=True)
class ToxicityModel:
    """All that scoring needs; its size depends on the number of landmarks alone."""

    similarity: Similarity
    weights: np.ndarray   # of the landmarks, the Nyström map folded in
    bias: float
    slopes: np.ndarray    # of a document's best margin, what its sentences add up to, and that for each sentence, as logarithms
    intercept: float

    def scores(self, texts) -> np.ndarray:
        home = sys.modules.setdefault("_recordflow_similarity", types.ModuleType("_recordflow_similarity"))
        known = home.__dict__.setdefault(" ".join(self.similarity.landmarks), self.similarity)
        out = []
        for batch in _batches(texts):
            known.learn({w for text in batch for w in text.lower().split()})
            for text in batch:
                gains = [float(v @ self.weights) for v in known.sums(text)]
                total = sum(g for g in gains if g > 0)
                sentences = len(_SENTENCE.split(text)) if total else 1
                found = np.array([max([0.0, *gains]) + self.bias, np.log1p(total), np.log(total / sentences + RARE)])
                out.append(1 / (1 + np.exp(-np.clip(float(self.slopes @ found) + self.intercept, -30, 30))))
        return np.array(out, dtype=float)


def _batches(texts, chars: int = 4_000_000) -> Iterator[list[str]]:
    """Whole texts in lists of about ``chars`` characters, so that new words are met many at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size > chars:
            yield part
            part, size = [], 0
    yield part


def _fragments(text: str) -> set[str]:
    """The words of a text and how they begin: landmarks may be stems that only stand with changing endings."""
    words = {w for w in _NO_LETTER.sub("", text.lower()).split() if LENGTH <= len(w) <= WINDOW}
    return words | {w[:n] + ON for w in words for n in range(LENGTH, min(STEM, len(w) - 1) + 1)}


def _tell(toxic, other, all_toxic: float, all_other: float):
    """How well a fragment tells the labels apart, from the rows of each label that hold it."""
    rate_t, rate_o = toxic / all_toxic, other / all_other
    return (rate_t - rate_o) / np.sqrt(np.maximum(rate_t + rate_o, 1e-12))


def choose_landmarks(rows: DataFrame, count: int = LANDMARKS) -> list[str]:
    """Words and stems that tell toxic from other labelled rows, each for rows that those before it miss.

    Fragments of three toxic rows or more are counted in all rows; the best ``_RANKED`` are looked up row by
    row. Each choice halves the weight of the toxic rows that hold it, so that insults of a language with few
    rows come in too. A fragment is chosen if most rows holding it are toxic and no chosen one is part of it
    or holds it.
    """
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    all_toxic, all_other = totals.get(1.0, 0), totals.get(0.0, 0)
    if not all_toxic or not all_other:
        return []

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            met = Counter(w for text in batch["text"] for w in _fragments(text))
            yield pd.DataFrame({"word": list(met), "n": list(map(float, met.values()))})

    common = (
        rows.where("label = 1").select("text").mapInPandas(counted, "word string, n double").groupBy("word").agg(F.sum("n").alias("n"))
        .where("n >= 3").orderBy(F.col("n").desc(), "word").limit(_COUNTED).collect())
    toxic = {r["word"]: r["n"] for r in common}

    def among(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                met.update(_fragments(text) & toxic.keys())
        if met:
            yield pd.DataFrame({"word": list(met), "n": list(map(float, met.values()))})

    clean = {r["word"]: r["n"] for r in rows.where("label = 0").select("text").mapInPandas(among, "word string, n double")
             .groupBy("word").agg(F.sum("n").alias("n")).collect()}
    score = {w: float(_tell(n, clean.get(w, 0.0), all_toxic, all_other)) * (LESS if w.endswith(ON) else 1.0)
             for w, n in toxic.items() if n >= clean.get(w, 0.0)}
    ranked = sorted(score, key=lambda w: (-score[w], -len(w), w))[:_RANKED]
    number = {w: i for i, w in enumerate(ranked)}

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"hits": [sorted(number[w] for w in _fragments(text) & number.keys()) for text in batch["text"]]})

    hits = [r["hits"] for r in rows.where("label = 1").select("text").mapInPandas(held, "hits array<int>").where("size(hits) > 0").collect()]
    grid = np.zeros((len(hits), len(ranked)))
    for n, row in enumerate(hits):
        grid[n, row] = 1.0
    weight, chosen = np.ones(len(hits)), []
    other = np.array([clean.get(w, 0.0) for w in ranked])
    open_ = np.ones(len(ranked), dtype=bool)
    worth = np.array([LESS if w.endswith(ON) else 1.0 for w in ranked])
    while len(chosen) < count and open_.any():
        gain = np.where(open_, _tell(weight @ grid, other, all_toxic, all_other) * worth, -np.inf)
        best = int(np.argmax(gain))
        if gain[best] < LEAST:
            break
        chosen.append(ranked[best])
        weight[grid[:, best] > 0] /= 2
        stem = ranked[best].rstrip(ON)
        open_ &= np.array([w not in stem and stem not in w for w in (r.rstrip(ON) for r in ranked)])
    return chosen


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", held: tuple[int, int] = (5, 0), most: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on the sentences of at most ``most`` labelled documents, whole texts.

    A sentence carries its document's label. Its kernel with a landmark is the sum over its words; the
    Nyström map turns these into features of a linear SVM. Sentences without any similar word are one
    weighted row per label. A logistic curve over a document's best margin, over what its sentences add
    up to and over the logarithm of that sum for each sentence gives the score: a word that is rarely an insult on its own
    counts by how often it recurs. Without both labels every score is 0.
    """
    rows = cut_lineage(labelled(docs, labels, column, held, most), "toxic-sample")
    similarity = Similarity(choose_landmarks(rows))
    if not similarity.landmarks:
        return ToxicityModel(similarity, np.zeros(0), 0.0, np.zeros(3), -30.0)
    gram = similarity.of(similarity.bare).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(gram)))
    nystrom = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            similarity.learn({w for text in batch["text"] for w in text.lower().split()})
            out = []
            for row, text, label in zip(batch["row"], batch["text"], batch["label"]):
                sums = similarity.sums(text)
                hits = [v @ nystrom for v in sums]
                out += [(row, label, 1.0, v.tolist()) for v in hits]
                out.append((row, label, float(max(0, len(_SENTENCE.split(text)) - len(hits))), [0.0] * len(nystrom)))
            yield pd.DataFrame(out, columns=["row", "label", "weight", "f"])

    measured = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(
        features, "row long, label double, weight double, f array<double>"), "toxic-features")
    zero = F.forall("f", lambda x: x == 0.0)
    thin = measured.where(~zero).select("label", "weight", "f").unionByName(
        measured.where(zero).groupBy("label").agg(F.sum("weight").alias("weight"), F.any_value("f").alias("f")))
    thin = cut_lineage(thin.repartition(_PARTS), "toxic-sentences")
    theta = _newton(thin, len(nystrom), _squared_hinge, 1e-3)
    weights, bias = theta[:-1], float(theta[-1])
    gain = F.aggregate(F.zip_with("f", F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    per_row = measured.withColumn("gain", F.greatest(F.lit(0.0), gain)).groupBy("row", "label").agg(
        F.max("gain").alias("best"), F.sum("gain").alias("total"), F.sum("weight").alias("sentences"))
    margins = cut_lineage(per_row.select(
        "label", F.lit(1.0).alias("weight"), F.array(F.col("best") + bias, F.log1p("total"), F.log(F.col("total") / F.col("sentences") + RARE)).alias("f")
    ).repartition(_PARTS), "toxic-margins")
    curve = _newton(margins, 3, _logistic, 1e-3)
    return ToxicityModel(similarity, nystrom @ weights, bias, curve[:3], float(curve[3]))


def _squared_hinge(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of a support vector machine's squared hinge at margins ``f``."""
    short = np.maximum(0.0, 1 - y * f)
    return short ** 2, -2 * y * short, 2.0 * (short > 0)


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(np.clip(y * f, -30, 30)))
    return -np.log1p(-np.minimum(p, 1 - 1e-12)), -y * p, p * (1 - p)


def _newton(rows: DataFrame, size: int, loss, ridge: float, rounds: int = 25) -> np.ndarray:
    """Minimise the weighted loss of (label, weight, f) rows; each partition sums, the driver adds up.

    Labels are 0 and 1. Steps are halved while the loss grows; sums have a fixed size.
    """
    theta, step, best = np.zeros(size + 1), np.zeros(size + 1), np.inf
    for _ in range(rounds):
        now = theta + step

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + (size + 1) + (size + 1) ** 2)
            for batch in batches:
                x = np.hstack([np.array(batch["f"].tolist(), dtype=float).reshape(-1, size), np.ones((len(batch), 1))])
                value, slope, curve = loss(x @ now, 2 * batch["label"].to_numpy() - 1)
                w = batch["weight"].to_numpy()
                total += np.concatenate([[np.sum(w * value)], x.T @ (w * slope), ((x * (w * curve)[:, None]).T @ x).ravel()])
            yield pd.DataFrame({"total": [total.tolist()]})

        total = np.sum([r["total"] for r in rows.mapInPandas(sums, "total array<double>").collect()], axis=0)
        value = total[0] + ridge * now @ now / 2
        if value > best + 1e-12:
            step = step / 2
            continue
        done = best - value < 1e-9 * max(1.0, abs(value))
        theta, best = now, value
        if done:
            break
        hessian = total[size + 2:].reshape(size + 1, size + 1) + ridge * np.eye(size + 1)
        step = -np.linalg.solve(hessian, total[1:size + 2] + ridge * theta)
    return theta


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from 0.5 on).

    Null and empty texts score as a text without any landmark. Rows with a null id are not held out.
    Copies score alike, an empty table gives no rows, other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    model = fit(rows, labels)
    scored = by_text(rows, "text", "score", "double", model.scores)
    return scored.select(
        "doc_id", F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
