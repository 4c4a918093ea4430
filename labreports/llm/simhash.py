"""SimHash near-duplicates: pivot distance tables discard pairs, exact distances verify the rest.

Two fingerprints that differ in at most two bits agree in at least one of three bands of bits, so
each band's value is a cell in which to look. Inside a cell every fingerprint has a row of Hamming
distances to reference fingerprints (pivots). Those distances obey the triangle inequality: a pair
whose rows differ by more than the radius in any coordinate can't be within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from labreports.llm.common import checkpointed, own_exchange, text_of
from labreports.llm.components import connected_components

RADIUS = 2
BANDS = ((0, 21), (21, 21), (42, 22))
PIVOTS = np.random.default_rng(3).integers(0, 2**64, 32, dtype=np.uint64)
_PIECE = 1 << 16


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of each ``width``-word shingle, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _PIECE):
        piece = words[at : at + _PIECE + width - 1]
        shingles = map(b" ".join, zip(*(piece[k:] for k in range(width))))
        if len(piece) < width:
            shingles = [b" ".join(piece)]
        digests = b"".join(map(xxh64_digest, shingles, repeat(seed)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": bits})

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null").select("doc_id", text_of("text").alias("text"))
    return rows.mapInPandas(run, f"doc_id {ids}, fp bigint")


def close_pairs(bits: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a spanning set of the close pairs of one cell: each pair of fingerprints within
    the radius is joined through the pairs returned."""
    n = len(bits)
    distances = np.bitwise_count(bits[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(distances[:, 0], kind="stable")
    bits, distances = bits[order], distances[order]
    # Only pairs whose first coordinates differ by the radius at most are looked at.
    ends = np.searchsorted(distances[:, 0], distances[:, 0] + radius, "right")
    root = np.arange(n)
    left_out, right_out = [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        near = slice(i + 1, ends[i])
        alive = np.arange(i + 1, ends[i])
        for k in range(1, len(PIVOTS), 4):
            if not alive.size:
                break
            gap = np.abs(distances[alive, k : k + 4] - distances[i, k : k + 4])
            alive = alive[gap.max(1) <= radius]
        for j in alive[np.bitwise_count(bits[alive] ^ bits[i]) <= radius]:
            a, b = find(i), find(int(j))
            if a != b:
                root[b] = a
                left_out.append(i)
                right_out.append(int(j))
    return order[left_out], order[right_out]


def _cell_links(cells: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for members in batch["members"]:
                members = np.asarray(members, np.int64)
                left, right = close_pairs(members.view(np.uint64))
                found.append(np.stack([members[left], members[right]]))
            pairs = np.hstack(found) if found else np.zeros((2, 0), np.int64)
            yield pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return cells.mapInPandas(run, "a bigint, b bigint")


def _ball_links(rows: DataFrame) -> DataFrame:
    """Links of cells too large to hold at once: two fingerprints within two bits have a common
    neighbour within one bit, and at most 65 fingerprints share such a neighbour."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1).cast("long") * F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    near = rows.select("fp", F.explode(flips).alias("flip"))
    keys = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    shared = keys.groupBy("key").agg(F.collect_list("fp").alias("members")).where("size(members) > 1")
    return shared.select(
        F.array_min("members").alias("a"), F.explode("members").alias("b")
    ).where("a <> b")


def fingerprint_links(fingerprints: DataFrame, cell_rows: int = 4096) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints ``fp`` that join every pair within two bits.

    A cell is held in one task only up to ``cell_rows`` fingerprints; those of larger cells are
    linked through common neighbours, which gives the same components.
    """
    bands = [
        F.struct(
            F.lit(k).alias("band"),
            F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1)).alias("value"),
        )
        for k, (low, size) in enumerate(BANDS)
    ]
    keyed = fingerprints.select("fp", F.explode(F.array(*bands)).alias("cell")).select("fp", "cell.*")
    sizes = keyed.groupBy("band", "value").count().where("count > 1")
    counted = keyed.withColumn("cell", own_exchange("band", "value")).join(
        sizes.select(own_exchange("band", "value").alias("cell"), "count"), "cell"
    )
    small = counted.where(F.col("count") <= cell_rows)
    cells = small.groupBy("band", "value").agg(F.collect_list("fp").alias("members"))
    large = counted.where(F.col("count") > cell_rows).select("fp").distinct()
    return _cell_links(cells.select("members")).union(_ball_links(large))


def near_duplicates(docs: DataFrame, cell_rows: int = 4096) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` with an id.

    ``component_id`` is the smallest document id reachable over links of fingerprints that differ
    in two bits at most. Null text counts as empty; empty texts have the fingerprint zero and are
    linked like any other. A long text is taken whole, in pieces of 65,536 words. Rows with a null id are left out, as they can't be named; repeated rows
    come back as often as they were given. Equal fingerprints meet once only: copies are counted
    before the shuffle and the join back to documents can be split.
    """
    marked = checkpointed(with_fingerprints(docs))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = fingerprint_links(distinct.select("fp"), cell_rows)
    members = connected_components(links)
    rooted = distinct.join(members, distinct["fp"] == members["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = checkpointed(rooted)
    least = (
        rooted.groupBy("root")
        .agg(F.min("first").alias("least"), F.count("*").alias("size"))
        .where("size > 1")
        .select(own_exchange("root").alias("group"), "least")
    )
    named = (
        rooted.withColumn("group", own_exchange("root"))
        .join(least, "group", "left")
        .select(own_exchange("fp").alias("key"), F.coalesce("least", "first").alias("component_id"))
    )
    return (
        marked.withColumn("key", own_exchange("fp"))
        .join(named, "key")
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )


def one_of_each(docs: DataFrame, cell_rows: int = 4096) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group of near duplicates.

    Rows that share an id are one document and stay or go together: an id goes if any of its rows is
    linked to a smaller id. Rows with a null id stay. Of all texts without words one document stays,
    as their fingerprints are equal. An empty table gives no rows.
    """
    named = near_duplicates(docs, cell_rows)
    gone = named.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
