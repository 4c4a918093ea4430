"""Benchmark decontamination: MinHash containment search by size class, verified exactly.

A short item inside a long document has a high containment but a tiny Jaccard similarity, so
two-sided MinHash bands would lose it. The search is one-sided instead. Items are divided by their
number of shingles, and each size class keeps a bottom-k MinHash sketch of every item with a k of
its own: one more than the shingles that an item of the class may lack at the threshold. A document
that reaches the threshold therefore holds at least one sketch member; none is lost. Documents are
read whole, once, and only those that hold a sketch member hand on shingles, which are then compared
as text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labreports.llm.common import checkpointed, own_exchange, text_of, written

# Punctuation and blanks beyond ASCII; all other characters beyond ASCII belong to words.
_WIDE_BREAKS = re.compile("[\u0080-\u00bf\u2000-\u206f\u3000-\u303f]+")
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_NOT_WORD = bytes(32 if not word else k for k, word in enumerate(_WORD_BYTES))

_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 21
#: A bit table has 32 bits for each shingle, but no fewer than the first, nor more than the second.
_FILTER_BITS = (25, 30)


def normal_bytes(text: str) -> bytes:
    """The text in lower case and UTF-8, with one blank for each character that parts words."""
    text = text.lower()
    if not text.isascii():
        text = _WIDE_BREAKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(_NOT_WORD)


def shingles_of(text: str, width: int = 5) -> list[str]:
    """Distinct shingles in order of appearance; a shorter text is one shingle of all its words."""
    words = normal_bytes(text).decode("utf-8").split(" ")
    words = [word for word in words if word]
    if len(words) < width:
        return [" ".join(words)] if words else []
    return list(dict.fromkeys(map(" ".join, zip(*(words[k:] for k in range(width))))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleHashes:
    """Hashes of all shingles of a buffer of normal bytes, by prefix sums of a polynomial."""

    def __init__(self, size: int):
        size += 2
        self.up = np.cumprod(np.full(size, _BASE, np.uint64))
        self.down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and 64-bit code of each word."""
        raw = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], _WORD_BYTES[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        return starts, ends, _mixed((sums[ends] - sums[starts]) * self.down[starts])

    @staticmethod
    def shingles(codes: np.ndarray, width: int) -> np.ndarray:
        """MinHash value of the shingle that begins at each word."""
        count = len(codes) - width + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        total = np.full(count, width, np.uint64)
        for k in range(width):
            total = _mixed(total * np.uint64(_BASE) + codes[k : k + count])
        return total


def size_class(count: int) -> int:
    """Items of 2^(c-1)+1 to 2^c shingles share the class c."""
    return max(0, math.ceil(math.log2(count)))


def sketch_size(count: int, threshold: float) -> int:
    """One more than the shingles that the largest item of the size class may lack."""
    upper = 2 ** size_class(count)
    return upper - math.ceil(threshold * upper - 1e-9) + 1


def _hash_of(shingle: str) -> int:
    data = shingle.encode("utf-8")
    codes = ShingleHashes(len(data)).words(data)[2]
    return int(ShingleHashes.shingles(codes, len(codes))[0])


def item_shingles(items: DataFrame, width: int, threshold: float) -> DataFrame:
    """``item_id, text_key, shingle, hash, span, in_sketch, n_shingles`` of each distinct shingle."""
    ids = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, key, text in zip(batch["item_id"], batch["text_key"], batch["text"]):
                found = sorted((_hash_of(s), s) for s in shingles_of(text, width))
                keep = sketch_size(len(found), threshold) if found else 0
                for rank, (value, shingle) in enumerate(found):
                    signed = value - (1 << 64) if value >> 63 else value
                    span = shingle.count(" ") + 1
                    rows.append((item, key, shingle, signed, span, rank < keep, len(found)))
            yield pd.DataFrame(rows, columns=names)

    schema = (
        f"item_id {ids}, text_key bigint, shingle string, hash bigint, span int, "
        "in_sketch boolean, n_shingles int"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    return items.select("item_id", F.xxhash64("text").alias("text_key"), "text").mapInPandas(run, schema)


def _table_bits(shingles: int) -> int:
    low, high = _FILTER_BITS
    return min(high, max(low, (32 * shingles).bit_length()))


def _bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit per hash value modulo 2^bits: 4 MB at least and 128 MB at most."""
    slot = F.col("hash").bitwiseAND((1 << bits) - 1)
    words = hashes.select(F.shiftright(slot, 5).alias("word"), slot.bitwiseAND(31).cast("int").alias("bit"))
    table = np.zeros(1 << (bits - 5), np.uint32)
    ored = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    for row in ored.toLocalIterator():
        table[row.word] = row.bits
    return table


def _blocks(data: bytes, overlap: int) -> Iterator[bytes]:
    """Pieces of a very long text that share ``overlap`` words, so that no shingle is cut."""
    while len(data) > 2 * _BLOCK:
        cut = data.find(b" ", _BLOCK)
        if cut < 0:
            break
        yield data[:cut]
        back = cut
        for _ in range(overlap):
            while back and data[back - 1] == 32:
                back -= 1
            back = data.rfind(b" ", 0, back) + 1
        data = data[back if back else cut :]
    yield data


def _document_shingles(docs: DataFrame, shingles: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingle`` of documents that hold a sketch member: the shingles that may be those
    of items. The two bit tables let a few others through, which the join on text removes.

    A text of several pieces hands on the shingles of all pieces once one holds a sketch member.
    Rows whose id is repeated hand on theirs whatever they hold, as another row may hold it.
    """
    counts = shingles.groupBy("span").count().collect()
    spans, bits = sorted(row.span for row in counts), _table_bits(sum(row["count"] for row in counts))
    sketch = _bit_table(shingles.where("in_sketch").select("hash"), bits)
    anywhere = _bit_table(shingles.select("hash"), bits)
    tables = docs.sparkSession.sparkContext.broadcast((sketch, anywhere))
    mask, ids = np.uint64((1 << bits) - 1), docs.schema["doc_id"].dataType.simpleString()

    def held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & mask
        return (table[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32) & 1) > 0

    def search(hasher: ShingleHashes, owners: list, parts: list[bytes], every: bool) -> Iterator[tuple]:
        """Search texts laid end to end; with ``every``, also those without a sketch member."""
        sketch, anywhere = tables.value
        data = b"\n".join(parts)
        firsts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        starts, ends, codes = hasher.words(data)
        owner = np.searchsorted(firsts, starts, "right") - 1
        for span in spans:
            hashes = hasher.shingles(codes, span)
            whole = owner[: len(hashes)] == owner[span - 1 :]
            chosen = np.full(len(parts), every)
            if not every:
                marked = np.flatnonzero(held(sketch, hashes) & whole)
                if not marked.size:
                    continue
                chosen[owner[marked]] = True
            for at in np.flatnonzero(held(anywhere, hashes) & whole & chosen[owner[: len(hashes)]]):
                words = data[starts[at] : ends[at + span - 1]].split()
                yield owners[owner[at]], b" ".join(words).decode("utf-8")

    def run(batches: Iterator[pd.DataFrame], every: bool) -> Iterator[pd.DataFrame]:
        hasher = ShingleHashes(2 * _BLOCK)
        for batch in batches:
            owners, parts, size, found = [], [], 0, []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                data = normal_bytes(text)
                if len(data) > 2 * _BLOCK:
                    pieces = list(_blocks(data, width - 1))
                    longest = max(map(len, pieces))
                    if longest > 2 * _BLOCK:
                        hasher = ShingleHashes(longest)
                    if every or any(True for piece in pieces for _ in search(hasher, [doc], [piece], False)):
                        for piece in pieces:
                            found += search(hasher, [doc], [piece], True)
                    continue
                if parts and size + len(data) > _BLOCK:
                    found += search(hasher, owners, parts, every)
                    owners, parts, size = [], [], 0
                owners.append(doc)
                parts.append(data)
                size += len(data) + 1
            if parts and spans:
                found += search(hasher, owners, parts, every)
            rows = pd.DataFrame(list(dict.fromkeys(found)), columns=["doc_id", "shingle"])
            yield rows.astype({"doc_id": batch["doc_id"].dtype})

    rows = docs.where("doc_id is not null").select("doc_id", text_of("text").alias("text"))
    schema = f"doc_id {ids}, shingle string"
    found = rows.mapInPandas(lambda batches: run(batches, False), schema)
    repeated = written(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return found
    again = rows.join(repeated, "doc_id", "left_semi")
    return found.union(again.mapInPandas(lambda batches: run(batches, True), schema))


def benchmark_leaks(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment`` of every document and item where at
    least ``threshold`` of the item's distinct word shingles stand in the document.

    Words are runs of ASCII letters and digits and of characters beyond ASCII that aren't
    punctuation, in lower case. An item of fewer words than ``width`` is one shingle of all its
    words. Long texts are searched whole, in pieces that share a shingle's words. Null and empty texts and null ids take no part. Rows of ``docs`` with the same id are one
    document; repeated items count once, and an item id with several texts leaks by the text with
    the largest containment. A passage may stand in a third of the documents: the join on its
    shingles can be split, and counts are combined before they are shuffled.
    """
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    wanted = checkpointed(item_shingles(items.distinct(), width, threshold))
    keys = wanted.select("item_id", "text_key", "n_shingles", "in_sketch", own_exchange("shingle").alias("key"))
    found = _document_shingles(docs.select("doc_id", "text"), wanted, width).distinct()
    return (
        found.withColumn("key", own_exchange("shingle"))
        .join(keys, "key")
        .groupBy("doc_id", "item_id", "text_key", "n_shingles")
        .agg(F.count("*").alias("n_shared"), F.max("in_sketch").alias("in_sketch"))
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
        .where(F.col("in_sketch") & (F.col("containment") >= threshold))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best"))
        .select("doc_id", "item_id", "best.n_shared", "best.n_shingles", "best.containment")
    )


def without_leaks(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """The rows of ``docs`` in which no item leaks; rows with a null id stay."""
    leaks = benchmark_leaks(docs, items, width, threshold).select("doc_id").distinct()
    return docs.join(leaks.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
