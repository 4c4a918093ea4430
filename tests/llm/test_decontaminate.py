from __future__ import annotations

import pytest

from labreports.llm.decontaminate import (
    _BLOCK,
    _blocks,
    benchmark_leaks,
    normal_bytes,
    shingles_of,
    sketch_size,
    without_leaks,
)
from tests.conftest import SMALL
from tests.llm.conftest import LONG


def plain_leaks(docs, items, threshold=0.8):
    out = {}
    for item, text in items:
        wanted = shingles_of(text)
        for doc, body in docs:
            words = " ".join(normal_bytes(body).decode().split())
            shared = sum(f" {s} " in f" {words} " for s in wanted)
            if wanted and shared / len(wanted) >= threshold:
                out[doc, item] = (shared, len(wanted))
    return out


def found(frame):
    return {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in frame.collect()}


def test_small_tables(spark, small_documents):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in small_documents.collect()]
    expected = plain_leaks(docs, [(r.item_id, r.text) for r in items.collect()])
    assert expected and found(benchmark_leaks(small_documents, items)) == expected


def test_threshold_short_items_and_word_forms(spark, documents):
    words = [f"w{k}" for k in range(24)]
    item = " ".join(words)
    partly = " ".join(words[:21])  # 17 of 20 shingles
    less = " ".join(words[:19])  # 15 of 20
    docs = [
        (1, f"before {item} after"),
        (2, f"{LONG} {item.upper().replace(' ', ', ')}! {LONG}"),
        (3, f"x {partly} y"),
        (4, f"x {less} y"),
        (5, "the short item stands here"),
        (6, "short the item"),
        (7, f"{partly} gap {' '.join(words[15:])}"),
    ]
    items = [(10, item), (11, "Short item"), (12, None), (13, " .,! "), (14, "“Über – Straße” über alles geht es")]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    expected = plain_leaks(docs, [(i, t) for i, t in items if t])
    got = found(benchmark_leaks(documents(docs), frame))
    assert got == expected
    assert set(got) == {(1, 10), (2, 10), (3, 10), (5, 11), (7, 10)}
    kept = without_leaks(documents([*docs, (None, item)]), frame)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "6", "None"]


def test_an_item_in_several_pieces_or_rows_of_a_document(spark, documents):
    words = [f"w{k}" for k in range(24)]
    item = " ".join(words)
    filler = "filler " * (_BLOCK // 6)
    halves = [" ".join(words[:cut]) for cut in range(5, 24)]
    rests = [" ".join(words[cut - 4 :]) for cut in range(5, 24)]
    docs = [(k, f"{a} {filler} {filler} {b}") for k, (a, b) in enumerate(zip(halves, rests)) if k % 6 == 1]
    docs += [(100 + k, f"x {text} y") for pair in (halves, rests) for k, text in enumerate(pair)]
    docs.append((200, f"{filler} {' '.join(words[:19])} {filler}"))
    frame = spark.createDataFrame([(10, item)], "item_id bigint, text string")
    expected = {(doc, 10): (20, 20) for doc, _ in docs if doc < 200}
    assert found(benchmark_leaks(documents(docs), frame)) == expected


@pytest.mark.parametrize("count", range(1, 200))
def test_a_sketch_can_not_be_missed(count):
    lacking = count - -(-8 * count // 10)  # shingles that an item may lack at 0.8
    assert sketch_size(count, 0.8) > lacking


def test_blocks_of_a_long_text_share_their_border_words():
    text = normal_bytes("alpha beta gamma delta " * (_BLOCK // 8))
    whole = text.split()
    seen = set()
    for part in _blocks(text, 4):
        words = part.split()
        seen |= set(zip(words, words[1:], words[2:], words[3:], words[4:]))
    assert seen == set(zip(whole, whole[1:], whole[2:], whole[3:], whole[4:]))


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "one"), (1, "one"), (2, "")], "item_id bigint, text string")
    assert found(benchmark_leaks(odd, items)) == {(5, 1): (1, 1)}
    assert found(benchmark_leaks(odd, items.limit(0))) == {}
    assert found(benchmark_leaks(odd.limit(0), items)) == {}
