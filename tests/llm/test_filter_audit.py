from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

from labreports.llm.filter_audit import audit_of, filter_audit, orders, removal_steps
from tests.llm.conftest import CLASHING

FIELDS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def plain_fails(rows):
    """The letters that each of (id, text) fails, one condition at a time."""
    out = []
    for doc, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [x for x, other in rows if (other or "") == text and x is not None]
        out.append(
            "A" * (len(words) < 200)
            + "B" * (100 * len(set(words)) < 50 * len(words))
            + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
            + "D" * any(c in "#$%&*|" for c in text)
            + "E" * (doc is not None and any(x < doc for x in same))
        )
    return out


def plain_audit(fails, good, toxic):
    """Apply the filters in each order to the documents of one part, one after another."""
    rows, removed_by = {}, dict.fromkeys("ABCDE", 0)
    for order in map("".join, permutations("ABCDE")):
        left, gone = list(range(len(fails))), []
        for step, letter in enumerate(order, 1):
            lost = [k for k in left if letter in fails[k]]
            again = [k for k in gone if letter in fails[k]]
            left = [k for k in left if letter not in fails[k]]
            gone += lost
            removed_by[letter] += len(lost)
            rows[order, step] = [
                len(left),
                len(lost),
                len(again),
                sum(f == letter for f in fails),
                sum(good[k] for k in lost),
                sum(toxic[k] for k in lost),
            ]
    return {key: (*row, removed_by[key[0][key[1] - 1]]) for key, row in rows.items()}


def found(frame):
    rows = frame.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[name] for name in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def expected(docs, labels):
    fails = plain_fails([(doc, text) for doc, text, _ in docs])

    def marked(doc, column):
        return int(any(row[0] == doc and row[column] == 1 for row in labels if doc is not None))

    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        own = [k for k, (_, _, lang) in enumerate(docs) if (lang or "") == part]
        flags = [[marked(docs[k][0], column) for k in own] for column in (1, 2)]
        for key, row in plain_audit([fails[k] for k in own], *flags).items():
            out[(part, *key)] = row
    return out


@pytest.fixture
def tables(spark):
    def build(docs, labels):
        extra = ", ".join(f"`{name}` string" for name in [*CLASHING, "mask", "part", "n", "good", "words"])
        schema = f"doc_id bigint, text string, lang string, {extra}"
        width = len(schema.split(",")) - 3
        docs = spark.createDataFrame([(*row, *["x"] * width) for row in docs], schema)
        return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")

    return build


def test_against_plain_filters(tables):
    random = np.random.default_rng(2)
    plain = [f"word{k}" for k in range(250)]
    texts = []
    for k in range(60):
        words = plain[: int(random.integers(150, 250))]
        if k % 3 == 0:
            words = words[:60] * 4
        if k % 4 == 0:
            words = [word.upper() for word in words]
        if k % 5 == 0:
            words = [*words, "a|b"]
        texts.append(" ".join(words))
    docs = [(k, texts[int(random.integers(60))], ["en", "de", None][k % 3]) for k in range(120)]
    labels = [(k, int(random.integers(2)), int(random.integers(2))) for k in range(0, 120, 2)]
    got = found(filter_audit(*tables(docs, labels)))
    assert got == expected(docs, labels) and len(got) == 3 * 600


def test_odd_rows(tables):
    long = "lorem ipsum dolor " * 20_000
    docs = [(1, None, "en"), (2, "", None), (2, "", ""), (3, " \n\t\x0b ", "en"), (4, long, "en")]
    docs += [(4, long, "en"), (5, long, "de"), (None, long, "en"), (None, None, None), (0, "one", "en")]
    docs += [(6, "ÉÉ no break", "fr"), (7, "ABC", "fr")]
    labels = [(1, 1, None), (1, 0, 1), (2, None, None), (5, 1, 1), (None, 1, 1), (99, 1, 1), (4, 0, 1)]
    assert found(filter_audit(*tables(docs, labels))) == expected(docs, labels)
    docs, labels = tables(docs, labels)
    assert filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit(docs, labels.limit(0)).count() == 4 * 600


def test_hot_text(tables):
    """A text that most rows share is counted, whichever rows it comes in."""
    docs = [(k, "same text" if k % 3 else f"other {k}", "en") for k in range(300)]
    assert found(filter_audit(*tables(docs, []))) == expected(docs, [])


def test_removal_steps_are_the_first_failing_place():
    masks = np.arange(32)
    steps = removal_steps(masks)
    for mask in range(32):
        for order, step in zip(orders(), steps[mask]):
            failing = [k for k, letter in enumerate(order) if mask >> "ABCDE".index(letter) & 1]
            assert step == (failing[0] if failing else 5)


def test_no_documents_of_a_mask():
    made = audit_of(np.array([0]), np.array([[7, 1, 2]]))
    assert len(made) == 600 and set(made["kept"]) == {7} and made["removed"].sum() == 0
