from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from labreports.llm.pii import KINDS, added_spans, base_spans, fit_pii, luhn, personal_data, redacted
from tests.llm.conftest import CLASHING, LONG


@pytest.fixture(scope="module")
def model():
    return fit_pii()


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_against_the_plain_patterns():
    chance = random.Random(7)
    parts = [*"0123456789..@@+-- ()aZ_%", "4111111111111111", "1.2.3.4", "00012.1.1.255", "\n", "é", "٣"]
    for _ in range(20_000):
        text = "".join(chance.choice(parts) for _ in range(chance.randrange(30)))
        assert base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 100_000, "a" * 100_000 + "@", "1." * 50_000, "+1" * 50_000, "1 " * 50_000])
def test_long_runs_take_linear_time(text, model):
    added_spans(text, base_spans(text), model)


@pytest.mark.parametrize("text", ["555 123 4567, ", "a.b [at] c.org "])
def test_many_candidates_take_linear_time(text, model):
    long = text * 50_000
    start = time.process_time()
    found = added_spans(long, base_spans(long), model)
    assert len(found) == 50_000 and time.process_time() - start < 60


def test_no_added_span_overlaps_another(model):
    chance = random.Random(3)
    parts = ["555 123 4567", "+1 314 555 6532", "1.2.3.4", "4111111111111111", "x@y.org", "a [at] b [dot] com", " ", ". ", "1"]
    for _ in range(300):
        text = "".join(chance.choice(parts) for _ in range(chance.randrange(1, 30)))
        base = base_spans(text)
        spans = added_spans(text, base, model)
        for k, (_, start, end) in enumerate(spans):
            others = [(s, e) for _, s, e in base] + [(s, e) for _, s, e in spans[:k]]
            assert start < end and all(end <= s or e <= start for s, e in others)


def test_the_query_against_the_plain_patterns(spark):
    from labreports.llm.queries import QUERIES
    from tests.conftest import SMALL

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op7_pii"](spark, SMALL).collect()
    assert len(rows) == len(texts) and any(r.n_email for r in rows)
    for row in rows:
        base = sorted(plain(texts[row.doc_id]))
        counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        named = [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert set(named) <= set(spans)
        key = [(KINDS.index(kind), int(s)) for kind, s, _ in (span.split(":") for span in spans)]
        assert key == sorted(key)


@pytest.mark.parametrize("text, kind, span", [
    ("call me at 555 123 4567 now", "phone", "555 123 4567"),
    ("mail john.doe [at] example [dot] com please", "email", "john.doe [at] example [dot] com"),
    ("tel +1 (314) 555-6532 4111111111111111 end", "phone", "+1 (314) 555-6532"),
    ("tel +1 (314) 555-6532 4111111111111111 end", "card", "4111111111111111"),
    ("date 2024-01-01 12:00:00", None, None),
    ("isbn 978-3-16-148410-0", None, None),
    ("look at the dot. Then at it", None, None),
    ("order 123456789012", None, None),
])
def test_added_spans(model, text, kind, span):
    found = [(KINDS[k], text[s:e]) for k, s, e in added_spans(text, base_spans(text), model)]
    assert (kind, span) in found if kind else not found


def test_odd_rows_and_redaction(spark, documents, model):
    rows = [(1, None), (2, ""), (3, LONG + "x@y.org"), (4, "é 1.2.3.4 +12345678"), (4, "é 1.2.3.4 +12345678"), (None, "a@b.c")]
    result = personal_data(documents(rows), model)
    assert set(CLASHING) <= set(result.columns)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in result.collect()}
    assert got == {
        1: [], 2: [], 3: [("email", len(LONG), len(LONG) + 7)], 4: [("ip", 2, 9), ("phone", 10, 19)],
        None: [("email", 0, 5)],
    }
    texts = {r.doc_id: r.text for r in redacted(result).collect()}
    assert texts[4] == "é [IP] [PHONE]" and texts[1] is None and texts[3] == LONG + "[EMAIL]"
    assert personal_data(documents(rows).limit(0), model).count() == 0
