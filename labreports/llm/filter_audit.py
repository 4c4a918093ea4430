"""Filter interaction audit: which filter removes how many documents, in every order of the filters.

A document is a mask of the filters that it fails. Documents are counted by mask first, so all orders
are worked out on a few rows: a mask matrix (0 where a filter fails, infinite elsewhere) and the
position matrix of the orders (the inverse of each permutation) combine by min-plus into the step at
which each order removes each mask. That step is where the counts are scattered to.
"""

from __future__ import annotations

import operator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labreports.llm.common import own_exchange, text_of

FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")
_KEPT = len(FILTERS)
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failures() -> Column:
    """Mask of the filters A to D that ``text`` with its ``words`` fails; bit k is the k-th letter."""
    size, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    conditions = [
        size < 200,
        100 * distinct.cast("long") < 50 * size.cast("long"),
        100 * capitals > 3 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    bits = [F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(conditions)]
    return reduce(operator.add, bits)


def orders() -> list[str]:
    return ["".join(order) for order in permutations(FILTERS)]


def positions() -> np.ndarray:
    """Orders x filters: at which place, from 0, each order applies each filter."""
    return np.array([[order.index(letter) for letter in FILTERS] for order in orders()], float)


def removal_steps(masks: np.ndarray) -> np.ndarray:
    """Masks x orders: the place in the order of the first filter that a mask fails; 5 if none."""
    failing = (masks[:, None] >> np.arange(len(FILTERS))) & 1
    cost = np.where(failing, 0.0, np.inf)
    steps = (cost[:, None, :] + positions()[None, :, :]).min(2)
    return np.where(np.isinf(steps), _KEPT, steps).astype(np.int64)


def audit_of(masks: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """The rows of one part from its masks and their numbers of documents, good and toxic ones."""
    names, place = orders(), positions().astype(np.int64)
    steps, width = removal_steps(masks), len(FILTERS)
    applied = np.argsort(place, axis=1)
    scattered = np.zeros((3, len(names), width + 1), np.int64)
    for k in range(3):
        for mask in range(len(masks)):
            np.add.at(scattered[k], (np.arange(len(names)), steps[mask]), counts[mask, k])
    removed, good, toxic = scattered[:, :, :width]
    failing = ((masks[:, None] >> np.arange(width)) & 1).astype(np.int64)
    # Removed before the filter's own place and failing it all the same.
    earlier = steps[:, :, None] < place[None, :, :]
    redundant = np.einsum("m,mf,mof->of", counts[:, 0], failing, earlier.astype(np.int64))
    alone = np.array([counts[masks == 1 << k, 0].sum() for k in range(width)])
    by_filter = np.take_along_axis(removed, place, axis=1)
    in_order = np.arange(width)
    total = counts[:, 0].sum()
    return pd.DataFrame(
        {
            "filter_order": np.repeat(names, width),
            "step": np.tile(in_order + 1, len(names)).astype(np.int32),
            "kept": (total - np.cumsum(removed, axis=1)).ravel(),
            "removed": removed.ravel(),
            "redundant": np.take_along_axis(redundant, applied, axis=1).ravel(),
            "unique_fails": alone[applied].ravel(),
            "good_lost": good.ravel(),
            "toxic_lost": toxic.ravel(),
            "shapley": by_filter.sum(0)[applied].ravel(),
        }
    )


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and by the filters that they fail."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    marked = (
        docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_of("text").alias("text"))
        .withColumn("words", words)
        .select(
            "doc_id",
            "part",
            failures().alias("mask"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        )
    )
    label = labels.where("doc_id is not null").groupBy("doc_id")
    label = label.agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    ).select(own_exchange("doc_id").alias("key"), "good", "toxic")
    nothing = F.lit(0)
    rated = (
        marked.where("doc_id is not null")
        .withColumn("key", own_exchange("doc_id"))
        .join(label, "key", "left")
        .withColumns({"good": F.coalesce("good", nothing), "toxic": F.coalesce("toxic", nothing)})
    )
    kind = ["digest", "mask", "part", "good", "toxic"]
    # A text's rows are counted before they meet: by id, then by what else the counts tell apart.
    by_id = rated.groupBy("key", *kind).agg(F.count("*").alias("n"))
    kinds = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min(F.struct("key.doc_id", "n")).alias("first")
    )
    texts = kinds.groupBy("digest", "mask").agg(
        F.collect_list(F.struct("part", "good", "toxic", "n", "first")).alias("kinds"),
        F.min("first.doc_id").alias("least"),
    )
    one = texts.select("mask", "least", F.explode("kinds").alias("k")).select("mask", "least", "k.*")
    original = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(
        F.struct(F.col("mask").alias("mask"), original.alias("n")),
        F.struct(
            F.col("mask").bitwiseOR(F.lit(_COPY)).alias("mask"), (F.col("n") - original).alias("n")
        ),
    )
    masked = one.select("part", "good", "toxic", F.explode(split).alias("m")).select(
        "part", "m.mask", "m.n", "good", "toxic"
    )
    unnamed = marked.where("doc_id is null").select(
        "part", "mask", F.lit(1).cast("long").alias("n"), nothing.alias("good"), nothing.alias("toxic")
    )
    return (
        masked.where("n > 0")
        .unionByName(unnamed)
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("good")).alias("good"),
            F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        )
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (language; null counts as empty), order of the five filters, and step.

    Null text counts as empty, which fails A only, and E if a smaller id has an empty text too. Texts
    are the same if their SHA-256 is. A row with a null id has no smaller id, is no smaller id, and
    carries no label. Rows that share an id are documents of their own, and none is a copy of the
    other. An id labelled more than once is good, or toxic, if any of its labels says so; null labels
    say nothing. Long texts are taken whole, within one row. Empty documents give no rows.

    Copies are counted before each shuffle, so a text that a third of all rows share arrives as a few
    rows; a part has 32 masks at most.
    """

    def audit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks = rows["mask"].to_numpy(np.int64)
        made = audit_of(masks, rows[["n", "good", "toxic"]].to_numpy(np.int64))
        made.insert(0, "part", key[0])
        return made

    return mask_counts(docs, labels).groupBy("part").applyInPandas(audit, RESULT)
