from __future__ import annotations

import zlib

import numpy as np
import pytest

from labreports.llm.quality import STATISTICS, fit_quality, fold, pooled, score_quality, statistics
from tests.llm.conftest import CLASHING


@pytest.fixture(scope="module")
def labelled(spark):
    path = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


@pytest.fixture(scope="module")
def model(labelled):
    return fit_quality(*labelled)


def test_fold(labelled):
    for row in labelled[1].select("doc_id", fold().alias("fold")).collect():
        assert row.fold == zlib.crc32(str(row.doc_id).encode()) % 5


def test_held_out_accuracy(labelled, model):
    docs, labels = labelled
    held = score_quality(docs, model).join(labels.where(fold() == 0), "doc_id").toPandas()
    assert len(held) > 50
    assert (held.predicted == held.quality).mean() >= 0.97
    assert held.score.between(0, 1).all()


def test_labels_of_the_held_out_fold_change_nothing(labelled, model):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    again = fit_quality(docs, flipped)
    assert np.allclose(again.weights, model.weights) and np.allclose(again.calibrated, model.calibrated)


def test_statistics():
    assert statistics("") == [0.0] * len(STATISTICS)
    assert len(statistics("a b\n\nc. d!")) == len(STATISTICS)
    assert all(np.isfinite(statistics(text)).all() for text in (" ", "\n", "x" * 100_000, "😀"))


def test_pooled():
    assert pooled(np.array([0.2, 0.1, 0.6]), np.array([1.0, 3.0, 1.0])).tolist() == [0.125, 0.125, 0.6]
    assert (np.diff(pooled(np.random.default_rng(0).random(50), np.ones(50))) >= 0).all()


def test_odd_rows(odd, model):
    result = score_quality(odd, model)
    rows = result.collect()
    assert len(rows) == odd.count() and set(CLASHING) <= set(result.columns)
    by_id = {}
    for row in rows:
        assert 0 <= row["score"] <= 1 and row.predicted == int(row["score"] >= 0.3)
        by_id.setdefault(row.doc_id, set()).add(row["score"])
    assert by_id[1] == by_id[2] == by_id[6] and len(by_id[4]) == 1
    assert score_quality(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(k, 1) for k in range(1, 7)], 1.0), ([(1, None)], 0.5)])
def test_without_labels_of_both_classes(spark, odd, labels, score):
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int")
    scores = {r["score"] for r in score_quality(odd, fit_quality(odd, frame)).collect()}
    assert scores == {score}


def plain_statistics(text):
    """Some of the numbers by their meaning, one character or word at a time."""
    data, words = text.encode(), text.split()
    lines = [line.split() for line in text.split("\n") if line.split()]
    n, size = max(1, len(words)), len(data)
    return {
        "log_chars": np.log(1 + len(text)),
        "log_words": np.log(1 + len(words)),
        "word_length": len(text) / n,
        "log_lines": np.log(1 + max(1, len(lines))),
        "upper": sum(65 <= b <= 90 for b in data) / size,
        "digit": sum(48 <= b <= 57 for b in data) / size,
        "space": sum(b in b" \t\n\r\x0b\x0c" for b in data) / size,
        "wide": sum(b >= 128 for b in data) / size,
        "bar": data.count(b"|") / size,
        "distinct": len(set(words)) / n,
        "repeated_next": sum(a == b for line in lines for a, b in zip(line, line[1:])) / n,
        "shouted": sum(word.isupper() for word in words) / n,
        "no_letter": sum(not word[0].isalpha() for word in words) / n,
        "ended": sum(line[-1][-1] in ".!?" for line in lines) / max(1, len(lines)),
        "log_longest": np.log(1 + max((len(word) for word in words), default=0)),
        "lines_distinct": len({tuple(line) for line in lines}) / max(1, len(lines)),
    }


def test_statistics_by_their_meaning(labelled):
    for row in labelled[0].where("length(text) > 0").limit(60).collect():
        found = dict(zip(STATISTICS, statistics(row.text)))
        for name, value in plain_statistics(row.text).items():
            assert found[name] == pytest.approx(value, abs=1e-12), name


def plain_isotonic(means, weights):
    """The max-min formula of the closest non-decreasing sequence."""
    n = len(means)
    average = lambda a, b: np.dot(means[a : b + 1], weights[a : b + 1]) / weights[a : b + 1].sum()
    return [max(min(average(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_pooled_by_the_max_min_formula():
    random = np.random.default_rng(1)
    for _ in range(30):
        n = int(random.integers(1, 25))
        means, weights = random.random(n).round(1), random.integers(1, 5, n).astype(float)
        assert pooled(means, weights) == pytest.approx(plain_isotonic(means, weights))


def test_fit_against_plain_numpy(labelled, model):
    """Features, normal equations and calibration over all labelled rows at once."""
    docs, labels = labelled
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(statistics(r.text or ""), known[r.doc_id], zlib.crc32(str(r.doc_id).encode()) % 5) for r in docs.collect() if r.doc_id in known]
    fitting = [row for row in rows if row[2] not in (0, 4)]
    x, y = np.array([row[0] for row in fitting]), np.array([row[1] for row in fitting], float)
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale, rtol=1e-5, atol=1e-7)

    def features(x):
        z = np.clip((x - model.mean) / model.scale, -8, 8)
        waves = np.zeros((len(z), len(model.phases)))
        for k, phase in enumerate(model.phases):
            waves[:, k] = np.sqrt(2 / len(model.phases)) * np.cos(z @ model.directions[:, k] + phase)
        return np.column_stack([np.ones(len(z)), z, waves])

    z = features(x)
    assert np.allclose(z, model.map(x))
    normal = sum(np.outer(row, row) for row in z) + len(z) * 1e-4 * np.eye(z.shape[1])
    weights = np.linalg.solve(normal, sum(row * label for row, label in zip(z, y)))
    assert np.allclose(weights, model.weights, atol=1e-4)
    # The features stand for a Gaussian kernel.
    a, b = (x[:40] - mean) / scale, (x[40:80] - mean) / scale
    kernel = np.exp(-0.02 * ((np.clip(a, -8, 8) - np.clip(b, -8, 8)) ** 2).sum(1))
    width = 1 + x.shape[1]
    assert np.abs((z[:40, width:] * z[40:80, width:]).sum(1) - kernel).mean() < 0.08

    held = [row for row in rows if row[2] == 4]
    raw = features(np.array([row[0] for row in held])) @ model.weights
    at = np.clip(((raw + 0.5) * 200).astype(int), 0, 399)
    filled = sorted(set(at.tolist()))
    weight = np.array([float((at == k).sum()) for k in filled])
    share = np.array([np.mean([row[1] for row, place in zip(held, at) if place == k]) for k in filled])
    level = (np.array(plain_isotonic(share, weight)) * weight.sum() + y.mean()) / (weight.sum() + 1)
    assert np.allclose(model.raw, (np.array(filled) + 0.5) / 200 - 0.5)
    assert np.allclose(model.calibrated, np.clip(level, 0, 1), atol=1e-9)
