from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from labreports.llm.spelling import spelling_variants
from tests.llm.conftest import CLASHING

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_counts(rows, every=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, UPPER.lower()))
            mark = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if mark % every == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return counts


def near(a, b):
    """One inserted, deleted or replaced code point, found by trying each place."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, least_length=6, least_count=5, ratio=5, every=199):
    words = {
        word: n
        for word, n in plain_counts(rows, every).items()
        if len(word) >= least_length and n >= least_count
    }
    by_size = {}
    for word in words:
        by_size.setdefault(len(word), []).append(word)
    found, forms = {}, {}
    for word, n in words.items():
        others = [x for size in (-1, 0, 1) for x in by_size.get(len(word) + size, [])]
        others = [x for x in others if near(word, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[word] = best if best and words[best] >= ratio * n else None
        found[word] = len(others)
    out = set()
    for word, form in forms.items():
        root = word
        while forms[root]:
            root = forms[root]
        out.add((word, form, root, words[word], found[word], form and words[form]))
    return out


def rows_of(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in frame.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_small_documents(small_documents):
    rows = [(r.doc_id, r.text) for r in small_documents.select("doc_id", "text").collect()]
    got = rows_of(spelling_variants(small_documents))
    assert got == plain_variants(rows) and len(got) > 100


@pytest.mark.parametrize("every", [199, 3])
def test_many_edits_of_few_words(documents, every):
    """Runs of equal letters, letters beyond ASCII, periodic words, and chains of forms."""
    random, rows = np.random.default_rng(5), []
    bases = ["aabbccdd", "abababab", "aaaaaa", "étéàÿ×÷", "zzzzzzzz", "MixedCase", "ÉCOLES"]
    letters = list("abzé")
    for doc in range(400):
        words = []
        for _ in range(30):
            word = bases[int(random.zipf(1.7)) % len(bases)]
            for _ in range(int(random.integers(0, 3))):
                at, kind = int(random.integers(len(word))), int(random.integers(3))
                letter = letters[int(random.integers(len(letters)))]
                word = word[:at] + ("" if kind == 0 else letter) + word[at + (kind != 1) :]
            words.append(word)
        rows.append((doc, "; ".join(words)))
    got = rows_of(spelling_variants(documents(rows), every=every))
    assert got == plain_variants(rows, every=every)
    assert any(form and root != form for _, form, root, *_ in got)


def test_chains_end_at_the_last_form(documents):
    sizes = {"stonewall": 700, "stonewalls": 120, "stonewallsz": 20, "stonewallszz": 4}
    rows = [(1, " ".join(" ".join([word] * n) for word, n in sizes.items()))]
    got = rows_of(spelling_variants(documents(rows), least_count=1, every=10**6))
    assert got == plain_variants(rows, least_count=1, every=10**6)
    assert {root for _, _, root, *_ in got} == {"stonewall"}


def test_long_words(documents):
    long = "loremipsumdolor" * 20
    rows = [(k, f"{long} {long[:-1]}x {long[:150]}{long[151:]} {long}y") for k in range(6)]
    assert rows_of(spelling_variants(documents(rows))) == plain_variants(rows)


def test_ties_go_to_the_smallest_word(documents):
    rows = [(1, " ".join(["carpet"] * 5 + ["carpes"] * 30 + ["carpez"] * 30 + ["carpey"] * 30))]
    found = {r.word: r for r in spelling_variants(documents(rows), every=10**6).collect()}
    assert (found["carpet"].form, found["carpet"].form_n, found["carpet"].n_near) == ("carpes", 30, 3)
    assert found["carpes"].form is None and found["carpes"].root == "carpes"


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert set(CLASHING) < set(odd.columns)
    assert rows_of(spelling_variants(odd, least_length=5)) == plain_variants(rows, least_length=5)
    assert spelling_variants(odd.limit(0)).count() == 0
    unnamed = odd.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("unnamed " * 9).alias("text"))
    assert rows_of(spelling_variants(unnamed)) == plain_variants([(None, "unnamed " * 9)] * 8)
    with pytest.raises(ValueError):
        spelling_variants(odd, ratio=1)
