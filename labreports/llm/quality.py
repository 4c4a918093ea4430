"""Quality classifier: random Fourier features, ridge scores and isotonic calibration."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labreports.llm.common import add_columns, checkpointed

STATISTICS = (
    "log_chars log_words word_length line_length log_lines upper digit punctuation symbol space "
    "wide distinct repeated_next repeated_next_line top_symbol_line shouted shouted_line "
    "no_letter bar ended log_longest lines_distinct rare_space last_line_symbol"
).split()

_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_SYMBOL = np.frombuffer(b"#$%&*@^~|<>=+_\\/{}[]`", np.uint8)
_SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_ODD_SPACE = np.frombuffer(b"\t\r\x0b\x0c", np.uint8)
_SYMBOLS = frozenset("#$%&*@^~|<>=+_\\/{}[]`!")


def statistics(text: str) -> list[float]:
    """Numbers about a whole text, in the order of STATISTICS; an empty text gives zeros."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not data.size:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(data, minlength=256) / data.size
    lines = [words for words in map(str.split, text.split("\n")) if words]
    words = [word for line in lines for word in line]
    n = max(1, len(words))
    repeated = repeated_line = symbol_line = shouted = shouted_line = 0.0
    plain = last_symbol = ended = 0
    for line in lines:
        size = len(line)
        again = sum(map(operator.eq, line, line[1:]))
        loud = sum(map(str.isupper, line))
        odd = sum(word[-1] in _SYMBOLS for word in line)
        repeated += again
        shouted += loud
        last_symbol += odd
        ended += line[-1][-1] in ".!?"
        plain += sum(not word[0].isalpha() for word in line)
        if size >= 4:
            repeated_line = max(repeated_line, again / size)
            shouted_line = max(shouted_line, loud / size)
            symbol_line = max(symbol_line, odd / size)
    rows = max(1, len(lines))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / n,
        np.log1p(len(text) / rows),
        np.log1p(rows),
        counts[_UPPER].sum(),
        counts[_DIGIT].sum(),
        counts[_PUNCTUATION].sum(),
        counts[_SYMBOL].sum(),
        counts[_SPACE].sum(),
        counts[128:].sum(),
        len(set(words)) / n,
        repeated / n,
        repeated_line,
        symbol_line,
        shouted / n,
        shouted_line,
        plain / n,
        counts[124],
        ended / rows,
        np.log1p(max(map(len, words), default=0)),
        len(set(map(tuple, lines))) / rows,
        counts[_ODD_SPACE].sum(),
        last_symbol / n,
    ]


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs; its size depends on the parameters of the fit only."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel, next to the statistics and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(x), 1)), z, waves])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.map(x) @ self.weights, self.raw, self.calibrated)


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def _measured(texts: list[str]) -> list[list]:
    return [list(map(statistics, texts))]


def _summed(blobs: DataFrame, size: int) -> np.ndarray:
    """Sum of one float array per partition, first in at most 32 groups; the driver gets those."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for blob in pdf["blob"]:
            total += np.frombuffer(blob)
        return pd.DataFrame({"slot": pdf["slot"][:1], "blob": [total.tobytes()]})

    schema = "slot int, blob binary"
    slots = blobs.withColumn("slot", (F.spark_partition_id() % 32).cast("int"))
    rows = slots.groupBy("slot").applyInPandas(add, schema).collect()
    return sum((np.frombuffer(row.blob) for row in rows), np.zeros(size))


def _partition_sum(frame: DataFrame, size: int, measure) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += measure(np.array(batch["x"].tolist()), batch["y"].to_numpy())
        yield pd.DataFrame({"blob": [total.tobytes()]})

    return _summed(frame.mapInPandas(run, "blob binary"), size)


def pooled(means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Closest non-decreasing sequence: pool adjacent violators."""
    blocks: list[list[float]] = []
    for mean, weight in zip(means, weights):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, k = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, a[2] + k
    return np.concatenate([[m] * k for m, _, k in blocks]) if blocks else np.zeros(0)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 50_000,
    waves: int = 192,
    gamma: float = 0.02,
    ridge: float = 1e-4,
    seed: int = 7,
) -> QualityModel:
    """Fit on the labelled rows whose fold isn't 0; fold 4 calibrates, the others fit the ridge.

    At most about ``max_labelled`` labels are used, chosen by a hash of the id, so the label side of
    the join has a proven size and only those documents are measured. Ids labelled more than once
    count with their mean. Without labels, or with labels of one class only, every score is the
    mean label (0.5 without any).
    """
    usable = labels.where("quality is not null and doc_id is not null").where(fold() != 0)
    known = usable.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    count = known.count()
    if count > max_labelled:
        share = int(0.98 * max_labelled / count * 2**31)
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share)
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    measured = checkpointed(
        add_columns(labelled, "text", "x array<double>", lambda: _measured, drop_source=True)
    ).select("x", "y", fold().alias("fold"))
    width = len(STATISTICS)
    fitting, calibrating = measured.where("fold <> 4"), measured.where("fold = 4")

    def moments(x, y):
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)])

    sums = _partition_sum(fitting, 2 + 2 * width, moments)
    n = max(1.0, sums[0])
    mean = sums[2 : 2 + width] / n
    spread = np.sqrt(np.maximum(sums[2 + width :] / n - mean**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    base = sums[1] / n if sums[0] else 0.5
    random = np.random.default_rng(seed)
    directions = random.normal(0, np.sqrt(2 * gamma), (width, waves))
    phases = random.uniform(0, 2 * np.pi, waves)
    size = 1 + width + waves
    model = QualityModel(mean, scale, directions, phases, np.zeros(size), np.zeros(1), np.array([base]))
    if not sums[0] or not 0 < base < 1:
        return model

    def equations(x, y):
        z = model.map(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    normal = _partition_sum(fitting, size * size + size, equations)
    left = normal[: size * size].reshape(size, size) + n * ridge * np.eye(size)
    weights = np.linalg.solve(left, normal[size * size :])
    bins = 400

    def histogram(x, y):
        at = np.clip(((model.map(x) @ weights + 0.5) * bins / 2).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, y, bins)])

    found = _partition_sum(calibrating, 2 * bins, histogram)
    if not found[:bins].any():
        found = _partition_sum(fitting, 2 * bins, histogram)
    filled = np.flatnonzero(found[:bins])
    # One row of each label in all keeps the ends away from 0 and 1.
    weight, positive = found[filled], found[bins + filled]
    level = pooled(positive / weight, weight)
    level = (level * weight.sum() + base) / (weight.sum() + 1)
    raw = (filled + 0.5) * 2 / bins - 0.5
    return QualityModel(mean, scale, directions, phases, weights, raw, np.clip(level, 0, 1))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` and ``predicted`` to every row of ``docs`` in one pass without a shuffle.

    Only the text decides; null counts as empty, and columns of these names are replaced. Repeated
    rows get equal scores, an empty table gives no rows.
    """

    def scored(texts: list[str]) -> list[list]:
        return [model.score(np.array(list(map(statistics, texts)))).tolist()]

    rated = add_columns(docs, "text", "score double", lambda: scored)
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return rated.withColumn("predicted", predicted)
