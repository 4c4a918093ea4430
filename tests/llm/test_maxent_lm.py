from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from labreports.llm import maxent_lm
from labreports.llm.maxent_lm import (
    Reader,
    Shape,
    Weights,
    count_tokens,
    first_weights,
    fit_maxent,
    model_scores,
    pieces,
    read_lexicon,
)
from tests.llm.conftest import CLASHING, LONG

SMALL_SHAPE = Shape(classes=3, places=4, rest=4, known=20, rows=64)
COLUMNS = "doc_id held_out n_tokens n_known train_tokens base_score score".split()


def plain_words(text):
    return (text or "").encode().lower().split()


def plain_base(rows):
    """The base of the contract, straight from its formula."""
    learned = [t for d, t in rows if d is None or crc32(str(d).encode()) % 10]
    counts = Counter(word for text in learned for word in [*plain_words(text), b""])
    tokens, distinct = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        words = [*plain_words(text), b""]
        base = sum(math.log10((counts[w] + 0.1) / (tokens + 0.1 * (distinct + 1))) for w in words)
        held_out = doc is not None and crc32(str(doc).encode()) % 10 == 0
        out.append((doc, held_out, len(words), sum(counts[w] > 0 for w in words), tokens, base))
    return out


def check_base(frame, rows):
    assert frame.columns == COLUMNS
    key = lambda row: (row[0] is None, row[0] or 0, row[2])
    got = sorted((tuple(r) for r in frame.collect()), key=key)
    for found, expected in zip(got, sorted(plain_base(rows), key=key), strict=True):
        assert found[:5] == expected[:5]
        assert found[5] == pytest.approx(expected[5], rel=1e-9, abs=1e-9)
        assert found[6] <= 0 and math.isfinite(found[6])
    return got


def test_small_documents(small_documents):
    rows = [(r.doc_id, r.text) for r in small_documents.select("doc_id", "text").collect()]
    got = check_base(model_scores(small_documents), rows)
    held = [row for row in got if row[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)


def sentences(count, seed=1):
    """Words that follow from the one before, or from the one two places back."""
    random, rows = np.random.default_rng(seed), []
    for doc in range(count):
        words = ["w0", "w1"]
        for _ in range(40):
            before = words[-1 if random.random() < 0.5 else -2]
            step = int(before[1:]) * 7 + int(random.integers(2))
            words.append(f"w{step % 40}")
        rows.append((doc, " ".join(words)))
    return rows


def test_learns_from_the_words_before(documents):
    rows = sentences(600)
    got = check_base(model_scores(documents(rows)), rows)
    held = [row for row in got if row[1]]
    gain = sum(r[6] - r[5] for r in held) / sum(r[2] for r in held)
    assert gain > 0.3


def reader_of(spark, rows, shape=SMALL_SHAPE):
    texts = spark.createDataFrame([(text,) for _, text in rows], "text string")
    return Reader(read_lexicon(count_tokens(texts), shape)), texts


def random_weights(lexicon, seed=0):
    random, first = np.random.default_rng(seed), first_weights(lexicon)
    made = [getattr(first, name) for name in Weights.TABLES]
    return Weights(*(a + np.where(a > -1e29, random.normal(0, 0.5, a.shape), 0).astype(a.dtype) for a in made))


def plain_token(reader, weights, before, word):
    """Natural log probability of a word by the model's definition, one weight at a time."""
    shape, n = reader.shape, reader.shape.width
    rows = [reader.arrays([w])[3][0] for w in before]
    _, kinds, places, _ = reader.arrays([word])

    def row(a, b, factor):
        mixed = (int(a) * 2654435761 + int(b) * factor) % 2**32 * 2246822519 % 2**32
        return (mixed >> 16) % shape.rows

    outer = [
        weights.outer_bias[0, c]
        + weights.outer[rows[2], c]
        + weights.outer[rows[1], n + c]
        + weights.outer[rows[0], n + c]
        for c in range(n)
    ]
    out = outer[kinds[0]] - math.log(sum(math.exp(x) for x in outer))
    if places[0] >= 0:
        kind = int(kinds[0])
        inner = [
            weights.inner_bias[kind, k]
            + weights.inner[row(rows[2], kind, 97), k]
            + weights.inner[row(rows[1], kind, 7919), k]
            for k in range(shape.places)
        ]
        out += inner[places[0]] - math.log(sum(math.exp(x) for x in inner))
    return out


def test_probabilities_by_definition_and_gradients_by_differences(spark):
    rows = sentences(30)
    reader, _ = reader_of(spark, rows)
    weights = random_weights(reader.lexicon)
    words = [None] * 3 + pieces_of(rows[0][1] + " unheard of") + [None] * 3 + pieces_of(rows[1][1])
    _, *arrays = reader.arrays(words)
    got = reader.log_probabilities(weights, *arrays)
    for at in range(3, len(words)):
        expected = plain_token(reader, weights, words[at - 3 : at], words[at]) if words[at] is not None else 0.0
        assert got[at - 3] == pytest.approx(expected, abs=2e-4)
    gradients = {name: np.zeros(getattr(weights, name).shape) for name in Weights.TABLES}

    def learn(name, at, gradient, counts):
        gradients[name][at] += gradient
        assert len(np.unique(at)) == len(at) and (counts > 0).all()

    reader.log_probabilities(weights, *arrays, learn=learn)
    wide = Weights(*(getattr(weights, name).astype(np.float64) for name in Weights.TABLES))
    for name in Weights.TABLES:
        table = getattr(wide, name)
        strongest = np.argsort(-np.abs(gradients[name]).ravel())[:6]
        for place in strongest:
            at = np.unravel_index(place, table.shape)
            kept, sides = table[at], []
            for move in (1e-4, -1e-4):
                table[at] = kept + move
                sides.append(-reader.log_probabilities(wide, *arrays).sum())
            table[at] = kept
            assert gradients[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-4, rel=2e-2, abs=2e-2)


def pieces_of(text):
    return [word for part in pieces(text) for word in part]


def test_classes_and_places_are_distributions(spark):
    reader, _ = reader_of(spark, sentences(30))
    lexicon, shape = reader.lexicon, reader.shape
    bias = np.exp(first_weights(lexicon).outer_bias[0].astype(float))
    assert bias.sum() == pytest.approx(1, abs=1e-5)
    rest = (lexicon.rest_tokens + 0.1 * (lexicon.rest_distinct + 1)).sum()
    named = (lexicon.counts[: lexicon.named] + 0.1).sum()
    assert rest + named == pytest.approx(lexicon.tokens + 0.1 * (lexicon.distinct + shape.rest))
    assert lexicon.words[0] == b"" and lexicon.tokens == 30 * 43


def test_counts_kept_small_on_the_way(spark, monkeypatch):
    rows = sentences(20)
    whole = {tuple(r) for r in reader_of(spark, rows)[1].transform(count_tokens).collect()}
    monkeypatch.setattr(maxent_lm, "_KEPT", 5)
    assert {tuple(r) for r in reader_of(spark, rows)[1].transform(count_tokens).collect()} == whole


def test_pieces_carry_the_context_on(spark, monkeypatch):
    """A long text scores as if it was taken in one."""
    rows = sentences(30)
    long = " ".join(text for _, text in rows) + "\x0b" + "x" * 500
    assert pieces_of(long) == [*plain_words(long), b""]
    reader, _ = reader_of(spark, rows)
    weights = random_weights(reader.lexicon)
    _, *arrays = reader.arrays([None] * 3 + pieces_of(long))
    whole = reader.log_probabilities(weights, *arrays).sum()
    monkeypatch.setattr(maxent_lm, "_PIECE", 100)
    monkeypatch.setattr(maxent_lm, "_BATCH", 50)
    sums = []

    def take(words, owners):
        _, *arrays = reader.arrays(words)
        values = reader.log_probabilities(weights, *arrays)
        assert len(values) == len(owners)
        sums.append(values[owners == 1].sum())

    stream = maxent_lm.Stream(take)
    stream.add(0, "something before")
    stream.add(1, long)
    stream.flush()
    assert sum(sums) == pytest.approx(whole, rel=1e-5) and len(sums) > 5


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert set(CLASHING) < set(odd.columns) and any(text == LONG for _, text in rows)
    got = check_base(model_scores(odd), rows)
    equal = [row for row in got if row[0] == 4]
    assert len(equal) == 2 and equal[0] == equal[1]
    assert model_scores(odd.limit(0)).count() == 0


def test_nothing_to_learn_from(documents):
    held = [d for d in range(200) if crc32(str(d).encode()) % 10 == 0][:3]
    rows = [(d, "some words") for d in held]
    got = check_base(model_scores(documents(rows)), rows)
    assert all(row[1] and row[3] == 0 and row[4] == 0 for row in got)


def test_rows_of_the_model_do_not_grow(spark):
    reader, texts = reader_of(spark, sentences(30))
    counts = count_tokens(texts)
    from pyspark.sql import functions as F

    model = fit_maxent(texts, counts, F.lit(0), rounds=1, shape=SMALL_SHAPE)
    assert [getattr(model.weights, n).shape for n in Weights.TABLES] == [(64, 14), (64, 4), (1, 7), (3, 4)]
    assert len(model.lexicon.words) <= SMALL_SHAPE.known


@pytest.mark.parametrize("most", [50, 70_000])
def test_rows_take_the_values_over_again(most):
    """Rows of two bytes and wider ones are summed alike; each row and its values stay together."""
    random = np.random.default_rng(2)
    rows = random.integers(0, most, 600).astype(np.uint32)
    values = random.normal(size=(300, 4)).astype(np.float32)
    got, sums, counts = maxent_lm._summed(rows, values)
    expected = {}
    for at, row in enumerate(rows.tolist()):
        expected[row] = expected.get(row, 0) + values[at % 300].astype(float)
    assert got.tolist() == sorted(expected) and counts.sum() == len(rows)
    np.testing.assert_allclose(sums, [expected[row] for row in got.tolist()], rtol=1e-4, atol=1e-4)


def test_tokens_computed_at_once_change_nothing(spark, monkeypatch):
    rows = sentences(30)
    reader, _ = reader_of(spark, rows)
    weights = random_weights(reader.lexicon)
    _, *arrays = reader.arrays([None] * 3 + pieces_of(" ".join(text for _, text in rows)))
    seen = []
    for at_once in (1 << 20, 7):
        monkeypatch.setattr(maxent_lm, "_AT_ONCE", at_once)
        gradients = []
        got = reader.log_probabilities(weights, *arrays, learn=lambda *given: gradients.append(given))
        seen.append((got, [part for given in gradients for part in given[1:]]))
    assert (seen[0][0] == seen[1][0]).all()
    assert all((a == b).all() for a, b in zip(*(parts for _, parts in seen), strict=True))
