"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class given the tokens before it, times its own within the
class. Features of the history are the previous word and words two and three places back (skips),
within a class the previous one and the one before it; each is hashed to a row of weights, one per class
or per word of a class.
The most frequent words are classes of equal size, by frequency. All other words form classes by their
last two bytes, in which a word counts by its smoothed number of occurrences in the training texts,
of which the corpus counts are never cut.

Training is one pass over all training texts, in rounds: every task starts from the common weights,
takes gradient steps over its part, and hands over the change of each row it touched. Changes are
averaged by how often each task touched the row. Scoring works on arrays of some thousand tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labreports.llm.common import own_exchange, text_of, written

#: Stands for the end of a text; no word is empty.
END = b""
#: Three of these stand before each text. They are context only.
_START = None
_BEFORE = 3
_SPACE = re.compile(rb"[ \t-\r]")
_PIECE = 1 << 16
_BATCH = 4096
#: Tokens whose probabilities are computed at once: the arrays of so few stay in the cache.
_AT_ONCE = 512
_ROUNDS = 8
_KEPT = 250_000
_FLOOR = np.float32(-1e30)


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A to Z in lower case, some thousand at a time; the last with the end."""
    data, at = text.encode("utf-8", "replace").lower(), 0
    while len(data) - at > _PIECE:
        cut = _SPACE.search(data, at + _PIECE)
        if cut is None:
            break
        yield data[at : cut.start()].split()
        at = cut.end()
    words = data[at:].split()
    words.append(END)
    yield words


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 10; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 10


def count_tokens(texts: DataFrame) -> DataFrame:
    """``word, c`` over all texts of the one column of ``texts``; the empty word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                for words in pieces(text.as_py() or ""):
                    counts.update(words)
                    if len(counts) >= _KEPT:
                        yield out()
                        counts.clear()
        if counts:
            yield out()

    counted = texts.mapInArrow(run, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Shape:
    """Sizes of the model. None grows with the corpus.

    ``known`` most frequent words are looked up in the tasks, ``classes * places`` of them have weights
    of their own, all others share ``rest`` classes. ``rows`` is the number of hashed rows of each
    table, a power of two.
    """

    classes: int = 32
    places: int = 32
    rest: int = 16
    known: int = 65_536
    longest: int = 64
    rows: int = 8192

    @property
    def width(self) -> int:
        return self.classes + self.rest


def rest_class(word: bytes, shape: Shape) -> int:
    return shape.classes + crc32(word[-2:]) % shape.rest


@dataclass(frozen=True)
class Lexicon:
    """What the tasks know of the corpus; its size is bounded by the shape."""

    shape: Shape
    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    rest_tokens: np.ndarray
    rest_distinct: np.ndarray

    @property
    def named(self) -> int:
        """Words with weights of their own."""
        return min(len(self.words), self.shape.classes * self.shape.places)


def read_lexicon(counts: DataFrame, shape: Shape) -> Lexicon:
    """The most frequent words, the end first, and totals over all of ``counts``."""
    short = counts.where(F.length("word") <= shape.longest).where(F.col("word") != F.lit(END))
    top = short.orderBy(F.desc("c"), "word").limit(shape.known - 1).toArrow()
    suffix = F.substring("word", F.greatest(F.length("word") - 1, F.lit(1)), F.lit(2))
    kind = (F.crc32(suffix) % shape.rest).cast("int").alias("kind")
    total = F.sum("c").cast("long").alias("tokens")
    sums = counts.groupBy(kind, (F.col("word") == F.lit(END)).alias("end"))
    tokens, distinct = np.zeros(shape.rest, np.int64), np.zeros(shape.rest, np.int64)
    ends = 0
    for row in sums.agg(total, F.count("*").alias("distinct")).collect():
        if row.end:
            ends = row.tokens
        else:
            tokens[row.kind], distinct[row.kind] = row.tokens, row.distinct
    words = [END, *top["word"].to_pylist()]
    numbers = np.array([ends, *top["c"].to_pylist()], np.int64)
    all_tokens, all_distinct = int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0)
    for word, c in zip(words[1 : shape.classes * shape.places], numbers[1:]):
        kind = rest_class(word, shape) - shape.classes
        tokens[kind] -= c
        distinct[kind] -= 1
    return Lexicon(shape, words, numbers, all_tokens, all_distinct, tokens, distinct)


@dataclass(frozen=True)
class Weights:
    """Rows of weights. A row of ``outer`` belongs to a hashed word: its weights as the previous word,
    then as a skipped one; a row of ``inner`` to a hashed word and a class."""

    outer: np.ndarray
    inner: np.ndarray
    outer_bias: np.ndarray
    inner_bias: np.ndarray

    TABLES = ("outer", "inner", "outer_bias", "inner_bias")

    def copy(self) -> Weights:
        return Weights(*(getattr(self, name).copy() for name in self.TABLES))


def first_weights(lexicon: Lexicon) -> Weights:
    """The smoothed unigram model."""
    shape = lexicon.shape
    mass = np.zeros(shape.width)
    places = np.full((shape.classes, shape.places), _FLOOR, np.float32)
    for at in range(0, lexicon.named, shape.places):
        c = lexicon.counts[: lexicon.named][at : at + shape.places] + 0.1
        mass[at // shape.places] = c.sum()
        places[at // shape.places, : len(c)] = np.log(c / c.sum())
    mass[shape.classes :] = lexicon.rest_tokens + 0.1 * (lexicon.rest_distinct + 1)
    bias = np.full((1, shape.width), _FLOOR, np.float32)
    bias[0, mass > 0] = np.log(mass[mass > 0] / mass.sum())
    zeros = [np.zeros((shape.rows, n), np.float32) for n in (2 * shape.width, shape.places)]
    return Weights(*zeros, bias, places)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of the values of each, and how many there are of each.

    The values may be fewer than the rows, which take them over again from the first. Most rows come
    a few times: those are added in rounds, the few frequent ones as blocks.
    """
    # Numbers of two bytes are sorted by counting.
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
    ordered = rows[order]
    sorted_values = values.take(order if len(values) == len(rows) else order % len(values), axis=0)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(starts, append=len(ordered))
    sums = sorted_values[starts]
    for k in range(1, _ROUNDS):
        more = np.flatnonzero(counts > k)
        sums[more] += sorted_values[starts[more] + k]
    for row in np.flatnonzero(counts > _ROUNDS).tolist():
        first = starts[row] + _ROUNDS
        sums[row] += sorted_values[first : starts[row] + counts[row]].sum(0)
    return ordered[starts], sums, counts


class Reader:
    """Turns streams of words into arrays and computes probabilities and gradients on them."""

    def __init__(self, lexicon: Lexicon):
        shape = self.shape = lexicon.shape
        self.lexicon = lexicon
        self.known = dict(zip(lexicon.words, range(len(lexicon.words))))
        self.known[_START] = len(lexicon.words)
        words, named = lexicon.words, lexicon.named
        kinds = [
            k // shape.places if k < named else rest_class(word, shape) for k, word in enumerate(words)
        ]
        rows = [crc32(word) % shape.rows for word in words]
        self.kinds = np.array([*kinds, -1], np.int16)
        self.rows = np.array([*rows, crc32(b" ") % shape.rows], np.uint32)
        places = np.arange(len(words) + 1) % shape.places
        self.places = np.where(np.arange(len(words) + 1) < named, places, -1).astype(np.int16)
        # What a word adds to the two scores whatever stands before it.
        tokens, distinct = lexicon.tokens, lexicon.distinct
        seen = np.log10(lexicon.counts + 0.1)
        self.base_total = np.log10(tokens + 0.1 * (distinct + 1))
        self.rest_total = np.log10(lexicon.rest_tokens + 0.1 * (lexicon.rest_distinct + 1))
        self.seen = np.concatenate([seen, [0.0]])
        self.counted = np.concatenate([lexicon.counts > 0, [False]])

    def arrays(self, words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of each word among the known ones (-1: none), its class, place and hashed row."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        kinds, places, rows = self.kinds[at], self.places[at], self.rows[at]
        others = np.flatnonzero(at < 0)
        if others.size:
            shape = self.shape
            unknown = [words[k] for k in others.tolist()]
            ends = np.array([crc32(word[-2:]) for word in unknown], np.uint32)
            kinds[others] = shape.classes + ends % np.uint32(shape.rest)
            places[others] = -1
            rows[others] = np.array([*map(crc32, unknown)], np.uint32) % np.uint32(shape.rows)
        return at, kinds, places, rows

    def _row_of(self, a: np.ndarray, b: np.ndarray, factor: int) -> np.ndarray:
        """The row of a hashed word together with a class."""
        mixed = (a * np.uint32(2654435761) + b * np.uint32(factor)) * np.uint32(2246822519)
        return (mixed >> np.uint32(16)).astype(np.int64) % self.shape.rows

    def log_probabilities(
        self,
        weights: Weights,
        kinds: np.ndarray,
        places: np.ndarray,
        rows: np.ndarray,
        learn: Callable | None = None,
    ) -> np.ndarray:
        """Natural log probability of each token behind the first three: of its class, and of its
        place where it has one. Tokens without a class count zero. ``learn`` gets the gradients."""
        width, n = self.shape.width, len(rows) - _BEFORE
        kind, place = kinds[_BEFORE:], places[_BEFORE:]
        targets = kind >= 0
        each = np.arange(n)
        near = rows[: n + 2]
        logits = np.empty((n, width), weights.outer.dtype)
        chosen, total = np.empty(n), np.empty((n, 1), logits.dtype)
        for low in range(0, n, _AT_ONCE):
            high = min(low + _AT_ONCE, n)
            shared = weights.outer.take(near[low : high + 2], axis=0)
            part = np.add(shared[2:, :width], weights.outer_bias, out=logits[low:high])
            part += shared[1:-1, width:]
            part += shared[:-2, width:]
            part -= part.max(1, keepdims=True)
            chosen[low:high] = part[each[: high - low], kind[low:high]]
            np.exp(part, out=part)
            part.sum(1, keepdims=True, out=total[low:high])
        out = np.where(targets, chosen - np.log(total[:, 0].astype(np.float64)), 0.0)

        inside = np.flatnonzero(place >= 0)
        own, at = kind[inside].astype(np.int64), place[inside]
        first = self._row_of(rows[inside + 2], own.astype(np.uint32), 97)
        second = self._row_of(rows[inside + 1], own.astype(np.uint32), 7919)
        inner = weights.inner.take(first, axis=0)
        inner += weights.inner.take(second, axis=0)
        inner += weights.inner_bias.take(own, axis=0)
        if inside.size:
            inner -= inner.max(1, keepdims=True)
        some = np.arange(len(inside))
        chosen = inner[some, at].astype(np.float64)
        np.exp(inner, out=inner)
        inner_total = inner.sum(1, keepdims=True)
        out[inside] += chosen - np.log(inner_total[:, 0].astype(np.float64))

        if learn is not None:
            logits /= total
            logits[each, kind] -= 1
            logits[~targets] = 0
            inner /= inner_total
            inner[some, at] -= 1
            spread = np.empty((n + 2, 2 * width), logits.dtype)
            spread[2:, :width] = logits
            spread[1:-1, width:] = logits
            spread[:2, :width] = spread[[0, -1], width:] = 0
            spread[:-2, width:] += logits
            learn("outer", *_summed(near, spread))
            learn("outer_bias", np.zeros(1, np.int64), logits.sum(0, keepdims=True), np.array([n]))
            if inside.size:
                both = np.concatenate([first, second])
                learn("inner", *_summed(both, inner))
                learn("inner_bias", *_summed(own, inner))
        return out


class Stream:
    """A run of texts as one list of words with starts between them, taken in batches."""

    def __init__(self, take: Callable[[list, np.ndarray], None]):
        self._take, self._words, self._owners = take, [_START] * _BEFORE, []

    def add(self, owner: int, text: str) -> None:
        self._words += [_START] * _BEFORE
        self._owners.append((owner, _BEFORE))
        for words in pieces(text):
            self._words += words
            self._owners.append((owner, len(words)))
            if len(self._words) > _BATCH:
                self.flush()

    def flush(self) -> None:
        owners = np.repeat(*np.array(self._owners, np.int64).reshape(-1, 2).T)
        if len(owners):
            self._take(self._words, owners)
        self._words, self._owners = self._words[-_BEFORE:], []


class Learner:
    """Gradient steps of one task, each row with a step size of its own."""

    def __init__(self, weights: Weights, sizes: dict[str, np.ndarray], rate: float):
        self.start, self.weights, self.rate = weights, weights.copy(), rate
        self.sizes = {name: size.copy() for name, size in sizes.items()}
        self.touched = {name: np.zeros(len(size), np.int64) for name, size in sizes.items()}

    def step(self, name: str, rows: np.ndarray, gradient: np.ndarray, counts: np.ndarray) -> None:
        table, size = getattr(self.weights, name), self.sizes[name]
        size[rows] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
        pace = (self.rate / np.sqrt(size[rows] + 1e-8)).astype(gradient.dtype)
        table[rows] -= gradient * pace[:, None]
        self.touched[name][rows] += counts

    def changes(self) -> Iterator[pd.DataFrame]:
        for name in Weights.TABLES:
            rows = np.flatnonzero(self.touched[name])
            change = (getattr(self.weights, name)[rows] - getattr(self.start, name)[rows]).astype(np.float16)
            yield pd.DataFrame(
                {
                    "name": name,
                    "row": rows.astype(np.int32),
                    "n": self.touched[name][rows],
                    "size": self.sizes[name][rows],
                    "change": [line.tobytes() for line in change],
                }
            )


_CHANGES = "name string, row int, n long, size double, change binary"


def _averaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean change of each row, weighted by how often each task touched it."""
    sums: dict[tuple[str, int], list] = {}
    for batch in batches:
        for name, row, n, size, change in zip(*(batch[c] for c in ("name", "row", "n", "size", "change"))):
            moved = n * np.frombuffer(change, np.float16).astype(np.float64)
            if (found := sums.get((name, row))) is None:
                sums[name, row] = [n, n * size, moved]
            else:
                found[0] += n
                found[1] += n * size
                found[2] += moved
    yield pd.DataFrame(
        {
            "name": [name for name, _ in sums],
            "row": np.array([row for _, row in sums], np.int32),
            "n": [n for n, _, _ in sums.values()],
            "size": [size / n for n, size, _ in sums.values()],
            "change": [(moved / n).astype(np.float16).tobytes() for n, _, moved in sums.values()],
        }
    )


@dataclass(frozen=True)
class MaxentModel:
    lexicon: Lexicon
    weights: Weights


def fit_maxent(
    texts: DataFrame,
    counts: DataFrame,
    share: Column,
    rounds: int = 3,
    rate: float = 0.2,
    shape: Shape | None = None,
) -> MaxentModel:
    """Fit on every text of ``texts``, once.

    A round takes the texts of one ``share``, a number from 0 below ``rounds`` for each row. There are at most four tasks a core, so the changes that
    are handed over don't grow with the number of files. Nothing but the model's rows, whose number
    is fixed by ``shape``, reaches the driver.
    """
    spark = texts.sparkSession
    lexicon = read_lexicon(counts, shape or Shape())
    weights = first_weights(lexicon)
    sizes = {name: np.zeros(len(getattr(weights, name))) for name in Weights.TABLES}
    tasks = 4 * spark.sparkContext.defaultParallelism
    for k in range(rounds if lexicon.tokens else 0):
        shared = spark.sparkContext.broadcast((lexicon, weights, sizes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            lexicon, weights, sizes = shared.value
            reader, learner = Reader(lexicon), Learner(weights, sizes, rate)

            def take(words: list, _: np.ndarray) -> None:
                _, *arrays = reader.arrays(words)
                for at in range(0, len(words) - _BEFORE, _BATCH):
                    part = [array[at : at + _BATCH + _BEFORE] for array in arrays]
                    reader.log_probabilities(learner.weights, *part, learn=learner.step)

            stream = Stream(take)
            for batch in batches:
                for text in batch["text"]:
                    stream.add(0, text or "")
            stream.flush()
            yield from learner.changes()

        own = texts.where(share == k).select(text_of("text").alias("text")).coalesce(tasks)
        changes = own.mapInPandas(run, _CHANGES).repartition("name", "row")
        moved = changes.mapInPandas(_averaged, _CHANGES).toPandas()
        shared.unpersist()
        weights, sizes = weights.copy(), {name: size.copy() for name, size in sizes.items()}
        for name, rows in moved.groupby("name"):
            at = rows["row"].to_numpy()
            change = np.frombuffer(b"".join(rows["change"]), np.float16).reshape(len(at), -1)
            getattr(weights, name)[at] += change.astype(np.float32)
            sizes[name][at] = rows["size"]
    return MaxentModel(lexicon, weights)


_SCORED = (
    "place long, n_tokens long, n_known long, base_score double, score double, words array<binary>"
)


def score_texts(docs: DataFrame, counts: DataFrame, model: MaxentModel) -> DataFrame:
    """Add ``n_tokens, n_known, train_tokens, base_score, score`` to the columns of ``docs`` other
    than the text; columns of these names are replaced.

    Both scores are log10 probabilities of the whole text with its end. Words that are not among the
    most frequent meet their counts in a join, once for each text, and join no hot key.
    """
    made = {"text", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    kept = [c for c in docs.columns if c.lower() not in made]
    named = [f"_{k}" for k in range(len(kept))]
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, named)], text_of("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = shared.value
        reader = Reader(lexicon)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = _scored(reader, weights, part.column(part.num_columns - 1))
                places = pa.array(range(place, place + part.num_rows), pa.int64())
                place += part.num_rows
                names = [*part.schema.names[:-1], "place", *made.schema.names]
                columns = [*part.columns[:-1], places, *made.columns]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = source.drop("text").schema.fields + StructType.fromDDL(_SCORED).fields
    scored = written(source.mapInArrow(run, StructType(fields)), "scored")
    # Their hash sorts faster than words do, and in the join it tells nearly all words apart.
    rare = scored.select("place", F.explode("words").alias("word"))
    rare = rare.withColumn("hash", F.xxhash64("word"))
    counted = counts.withColumn("hash", F.xxhash64("word"))
    # A word that training has not seen adds log10(0.1), which is counted already.
    found = rare.join(counted, ["hash", "word"]).groupBy("place").agg(
        F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 0.1) + 1).alias("log")
    )
    total = F.lit(model.lexicon.tokens).cast("long")
    log, more = F.coalesce("log", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.join(found, "place", "left").select(
        *[F.col(n).alias(c) for c, n in zip(kept, named)],
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        total.alias("train_tokens"),
        (F.col("base_score") + log).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )


def _scored(reader: Reader, weights: Weights, texts: pa.Array) -> pa.RecordBatch:
    """Results of some texts as far as the known words tell, and their other words."""
    n = len(texts)
    shape = reader.shape
    tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
    base, score = np.zeros(n), np.zeros(n)
    rare: list[bytes] = []
    rare_of = np.zeros(n + 1, np.int32)

    def take(words: list, owners: np.ndarray) -> None:
        at, kinds, places, rows = reader.arrays(words)
        at, kind, place = at[_BEFORE:], kinds[_BEFORE:], places[_BEFORE:]
        logs = np.concatenate(
            [
                reader.log_probabilities(
                    weights, *(a[k : k + _AT_ONCE + _BEFORE] for a in (kinds, places, rows))
                )
                for k in range(0, len(owners), _AT_ONCE)
            ]
        )
        targets, rest = kind >= 0, (kind >= 0) & (place < 0)
        seen = np.where(at >= 0, reader.seen[at], -1.0)
        logs = logs / np.log(10)
        logs[rest] += seen[rest] - reader.rest_total[kind[rest] - shape.classes]
        low, high = owners[0], owners[-1] + 1
        local, size = owners - low, high - low

        def add(out: np.ndarray, values: np.ndarray) -> None:
            out[low:high] += np.bincount(local, values, size).astype(out.dtype)

        add(tokens, targets.astype(float))
        add(known, (targets & (at >= 0) & reader.counted[at]).astype(float))
        add(base, np.where(targets, seen - reader.base_total, 0.0))
        add(score, logs)
        others = np.flatnonzero(at < 0)
        rare.extend(words[k] for k in (others + _BEFORE).tolist())
        rare_of[low + 1 : high + 1] += np.bincount(local[others], minlength=size).astype(np.int32)

    stream = Stream(take)
    for k, text in enumerate(texts):
        stream.add(k, text.as_py() or "")
    stream.flush()
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(rare_of, dtype=np.int32)), pa.array(rare, pa.binary()))
    columns = [*map(pa.array, (tokens, known, base, score)), lists]
    names = ["n_tokens", "n_known", "base_score", "score", "words"]
    return pa.RecordBatch.from_arrays(columns, names)


def model_scores(docs: DataFrame, rounds: int = 3, **fit) -> DataFrame:
    """``doc_id, held_out`` and the columns of ``score_texts`` for every row of ``docs``.

    The model learns from all rows whose fold isn't 0; a null id has no fold, is learned from and is
    not held out. Null text counts as empty: its only token is the end. Repeated rows are learned
    from, and come back, as often as they are given. A long text is taken whole, in pieces of 64 KB
    that carry their context on. If no row is learned from, each token scores what an unseen one
    does. An empty table gives no rows.
    """
    held_out = F.coalesce(fold() == 0, F.lit(False))
    learned = docs.where(~held_out)
    counts = written(count_tokens(learned.select("text")), "counts")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    model = fit_maxent(learned, counts, share, rounds, **fit)
    return score_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), counts, model)
