"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import by_text, crc_of, fresh, ship, text_or_empty
from recordflow.runtime import cut_lineage

ship(__name__)

MAX_LABELLED = 20_000  # labelled rows a fit looks at, the first ones by hash of their id
FEATURES = 256         # random Fourier features
BANDWIDTH = 3.0        # of the Gaussian kernel over standardised statistics
RIDGE = 1.0
THRESHOLD = 0.7
_PARTS = 8             # partitions of the fit
_SLICES = 64           # of the sums, added up on their own

_UPPER = re.compile(r"[A-ZÀ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"[0-9]")
_MARKS = "!|*#$%&<>{}[]=\\/^~_@+"
NAMES = 18


def statistics(text: str) -> list[float]:
    """Figures of a whole text; all are zero for an empty one."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * NAMES
    distinct = len(set(words))
    repeated = sum(map(str.__eq__, words, words[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    letters, upper, digits = (len(p.findall(text)) for p in (_LETTER, _UPPER, _DIGIT))
    marks = [text.count(m) for m in _MARKS]
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = sum(text.count(m) for m in ".?;:")
    return [
        float(np.log1p(n)), distinct / n, repeated / n, chars / n,
        letters / chars, upper / max(1, letters), digits / chars,
        sum(marks) / n, marks[0] / n, marks[1] / n, sum(marks[2:7]) / n,
        max(marks) / n, text.count(",") / n, ends / n,
        len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        float(lengths.std() / lengths.mean()), float(np.log1p(lengths.max())),
    ]


@dataclass(frozen=True)
class QualityModel:
    """All that scoring needs; its size depends on the number of features alone."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.waves + self.phase) * np.sqrt(2 / self.waves.shape[1])
        return np.hstack([waves, np.ones((len(z), 1))])

    def scores(self, texts) -> np.ndarray:
        stats = np.array([statistics(t) for t in texts], dtype=float).reshape(-1, NAMES)
        raw = self.fourier(stats) @ self.weights
        return np.clip(np.interp(raw, *self.steps), 0.0, 1.0)


def labelled(docs: DataFrame, labels: DataFrame, column: str, held: tuple[int, int], most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, label) of the documents that may be learned from, ``most`` labels at most.

    Labels of documents whose crc32(doc_id as text) mod ``held[0]`` is ``held[1]``, null labels and null
    ids take no part. Of repeated labels of an id the greatest counts. The label rows taken are the first
    by hash of the id; their number is bounded, so they are broadcast.
    """
    sample = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .where(crc_of("doc_id") % held[0] != held[1])
        .groupBy("doc_id").agg(F.max(column).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    sample = cut_lineage(sample, "label-sample")
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", held: tuple[int, int] = (4, 2), most: int = MAX_LABELLED) -> QualityModel:
    """Fit on at most ``most`` labelled documents, whole texts.

    Random Fourier features approximate a Gaussian kernel over standardised statistics; each partition
    sums its normal equations, the sums are added up slice by slice, and only the total reaches the driver,
    whatever the number of partitions. Every
    fifth document by hash is left out of the ridge fit and calibrates it by isotonic regression. Without
    labelled rows every score is 1.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), stats], names=["doc_id", "label", "stats"])

    rows = cut_lineage(
        labelled(docs, labels, column, held, most).select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(measure, "doc_id long, label double, stats array<double>")
        .withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0), "quality-stats")
    figures = [F.col("stats")[i] for i in range(NAMES)]
    moments = rows.agg(F.count("*"), *[F.avg(c) for c in figures], *[F.stddev_pop(c) for c in figures]).first()
    rng = np.random.default_rng(7)
    waves, phase = rng.normal(0, 1 / BANDWIDTH, (NAMES, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    size = FEATURES + 1
    if not moments[0]:
        return QualityModel(np.zeros(NAMES), np.ones(NAMES), waves, phase, np.zeros(size), (np.array([0.0]), np.array([1.0])))
    mean = np.array(moments[1:NAMES + 1], dtype=float)
    scale = np.maximum(np.array(moments[NAMES + 1:], dtype=float), 1e-9)
    blank = QualityModel(mean, scale, waves, phase, np.zeros(size), (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, moment, rows = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            x = blank.fourier(np.array(batch["stats"].tolist(), dtype=float).reshape(-1, NAMES))
            gram += x.T @ x
            moment += x.T @ batch["label"].to_numpy()
            rows += len(x)
        parts = np.array_split(np.column_stack([gram, moment]), _SLICES) if rows else []
        yield pd.DataFrame({"slice": range(len(parts)), "part": TaskContext.get().partitionId(), "sums": [p.tobytes() for p in parts]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch["slice"], batch["sums"]):
                totals[at] = totals.get(at, 0) + np.frombuffer(packed)
        yield pd.DataFrame({"slice": list(totals), "sums": [t.tobytes() for t in totals.values()]})

    fits = rows.where("not calibrates")
    parts = fits.repartition(_PARTS, "doc_id").mapInPandas(sums, "slice int, part int, sums binary")
    added = parts.repartition(_SLICES, "slice").sortWithinPartitions("part").mapInPandas(add, "slice int, sums binary")
    whole = np.zeros((size, size + 1))
    for total, row in zip(np.array_split(whole, _SLICES), sorted(added.collect(), key=lambda r: r["slice"])):
        total += np.frombuffer(row["sums"]).reshape(total.shape)
    gram, moment = whole[:, :size], whole[:, size]
    weights = np.linalg.solve(gram + RIDGE * np.eye(size), moment)
    model = QualityModel(mean, scale, waves, phase, weights, blank.steps)

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = model.fourier(np.array(batch["stats"].tolist(), dtype=float).reshape(-1, NAMES))
            yield pd.DataFrame({"raw": x @ weights, "label": batch["label"]})

    held_out = rows.where("calibrates")
    scored = cut_lineage((fits if held_out.isEmpty() else held_out).mapInPandas(raw, "raw double, label double"), "quality-raw")
    vector = VectorAssembler(inputCols=["raw"], outputCol="features").transform(scored)
    isotonic = IsotonicRegression(labelCol="label").fit(vector)
    steps = (np.array(isotonic.boundaries.toArray()), np.array(isotonic.predictions.toArray()))
    return QualityModel(mean, scale, waves, phase, weights, steps)


def with_score(docs: DataFrame, model: QualityModel, out: str = "_score") -> DataFrame:
    """Every row with ``out``, a score from 0 to 1 of its whole text; null texts score as empty ones.

    One narrow pass; the model has a fixed size.
    """
    return by_text(docs, "text", out, "double", model.scores)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from 0.7 on).

    Rows with a null id are not held out. Copies and ties score alike, an empty table gives no rows, and
    other columns are ignored whatever their names.
    """
    rows = docs.select("doc_id", "text")
    scored = with_score(rows, fit(rows, labels))
    return scored.select(
        "doc_id", F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is 0.7 or more, with the columns they came with."""
    score = fresh(docs, "_score")
    scored = with_score(docs, fit(docs.select("doc_id", "text"), labels), score)
    return scored.where(F.col(score) >= THRESHOLD).drop(score)
