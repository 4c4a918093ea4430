"""Approximate nearest neighbours: a forest of random-projection trees, then exact reranking.

The trees are fitted on a bounded sample; every row is indexed by its leaf in each tree. A search
walks all trees at once through one priority queue, where a branch ranks by the smallest margin on
its path, and takes the first leaves that come out. How many it takes is measured on the sample, so
that it finds the wanted share of true neighbours: few leaves where vectors form clusters, a large
part of the forest where they don't. Candidates of the leaves are ranked by exact cosine.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labreports.llm.common import checkpointed

_LEAF_ROWS = 64
_SLICE_ROWS = 4096
_QUERY_ROWS = 8192
#: Queries that a task ranks at once, and pairs that it measures exactly at once.
_ASKED_AT_ONCE = 256
_PAIRS = 1 << 16
#: More than rounding can part two ways to take a cosine.
_MARGIN = 1e-9


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node n has the children 2n+1 and 2n+2."""

    planes: np.ndarray  # trees x nodes x dimensions
    offsets: np.ndarray  # trees x nodes
    depth: int
    pops: int  # leaves that a search takes

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector (rows) in each tree (columns)."""
        out = np.zeros((len(unit), len(self.planes)), np.int32)
        for tree, (planes, offsets) in enumerate(zip(self.planes, self.offsets)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", unit, planes[node]) >= offsets[node]
                node = 2 * node + 1 + side
            out[:, tree] = node - ((1 << self.depth) - 1)
        return out

    def search(self, unit: np.ndarray, pops: int | None = None) -> Iterator[tuple[int, int]]:
        """Tree and leaf in the order in which the shared priority queue gives them out."""
        trees, inner = len(self.planes), (1 << self.depth) - 1
        margins = (self.planes @ unit - self.offsets).tolist()
        queue = [(-math.inf, tree, 0) for tree in range(trees)]
        left = self.pops if pops is None else pops
        while queue and left > 0:
            worst, tree, node = heapq.heappop(queue)
            if node >= inner:
                left -= 1
                yield tree, node - inner
                continue
            margin = margins[tree][node]
            heapq.heappush(queue, (max(worst, -margin), tree, 2 * node + 2))
            heapq.heappush(queue, (max(worst, margin), tree, 2 * node + 1))


def _grown(unit: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
    random = np.random.default_rng(seed)
    nodes, size = (1 << depth) - 1, unit.shape[1]
    planes, offsets = np.zeros((trees, nodes, size)), np.zeros((trees, nodes))
    for tree in range(trees):
        members = {0: np.arange(len(unit))}
        for node in range(nodes):
            own = members.pop(node)
            direction = random.normal(size=size)
            planes[tree, node] = direction / np.linalg.norm(direction)
            along = unit[own] @ planes[tree, node]
            offsets[tree, node] = np.median(along) if len(own) else 0.0
            right = along >= offsets[tree, node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return Forest(planes, offsets, depth, trees << depth)


def fit_forest(
    vectors: DataFrame,
    column: str,
    trees: int = 12,
    sample: int = 16_384,
    recall: float = 0.97,
    neighbours: int = 5,
    seed: int = 11,
) -> Forest:
    """Fit on at most about ``sample`` rows, chosen by a hash of the vector, and measure there how
    many leaves a search must take to find ``recall`` of the ``neighbours`` nearest. ``vectors`` are
    distinct, so the hash bounds the rows."""
    count = max(1, vectors.count())
    share = F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * sample / count)
    chosen = (vectors if count <= sample else vectors.where(share)).select(column).toPandas()
    rows = [np.asarray(v, np.float64) for v in chosen[column]]
    if not rows:
        return Forest(np.zeros((trees, 0, 1)), np.zeros((trees, 0)), 0, trees)
    unit = np.stack(rows)
    unit = np.unique(unit / np.linalg.norm(unit, axis=1, keepdims=True), axis=0)
    depth = min(8, max(0, math.ceil(math.log2(len(unit) / _LEAF_ROWS))))
    forest = _grown(unit, trees, depth, seed)
    tried = np.random.default_rng(seed).permutation(len(unit))[:400]
    near = unit[tried] @ unit.T
    near[np.arange(len(tried)), tried] = -2
    best = np.argsort(-near, axis=1)[:, : min(neighbours, len(unit) - 1)]
    where, ranks = forest.leaves(unit), []
    for query, found in zip(tried, best):
        order = {place: k for k, place in enumerate(forest.search(unit[query], trees << depth))}
        for other in found:
            ranks.append(min(order[tree, leaf] for tree, leaf in enumerate(where[other].tolist())))
    pops = int(np.quantile(ranks, recall)) + 1 if ranks else trees
    return Forest(forest.planes, forest.offsets, depth, max(trees, pops))


def usable(column: str) -> Column:
    """Not null, not zero, and every component a finite number."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~odd & F.exists(column, lambda x: x != 0)


def _unit(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_list()).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _best_of_slice(
    queries: pd.DataFrame, members: np.ndarray, unit: np.ndarray, ids: list, neighbours: int
) -> list[tuple]:
    """For each query its best members by exact cosine, ties by id, as (query, id, score).

    The exact measure is taken of every member that the product of matrices doesn't put below the
    last place by more than rounding can, so ties are all looked at.
    """
    own = queries["id"].to_list()
    q = np.stack(queries["v"].to_list()).astype(np.float64)
    norms, member_norms = np.sqrt((q * q).sum(1)), np.sqrt((members * members).sum(1))
    near = (q / norms[:, None]) @ unit.T
    # One place more, as one of them may be the query itself.
    width = min(neighbours + 1, near.shape[1])
    last = np.partition(near, near.shape[1] - width, axis=1)[:, near.shape[1] - width]
    left, right = np.nonzero(near >= (last - _MARGIN)[:, None])
    out = []
    for at in range(0, len(left), _PAIRS):
        a, b = left[at : at + _PAIRS], right[at : at + _PAIRS]
        out.append((q[a] * members[b]).sum(1) / (norms[a] * member_norms[b]))
    scores = np.concatenate(out) if out else np.zeros(0)
    sizes = np.array([len(ids[b]) for b in right], np.int64)
    pair = np.repeat(np.arange(len(left)), sizes)
    found = np.concatenate([np.asarray(ids[b]) for b in right]) if len(right) else np.zeros(0, np.int64)
    asked, score = left[pair], scores[pair]
    order = np.lexsort((found, -score, asked))
    taken: dict[int, int] = {}
    best = []
    for k in order.tolist():
        query, other = int(asked[k]), found[k]
        if other != own[query] and taken.get(query, 0) < neighbours:
            taken[query] = taken.get(query, 0) + 1
            best.append((own[query], other, score[k]))
    return best


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    column: str = "embedding",
    neighbours: int = 5,
    **fit,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the rows nearest by cosine, found in the
    leaves that the search takes; ties go to the smaller id and a row never finds its own id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    with a null id or with another number of components than most of a sample have. Repeated rows
    count once; long vectors are taken whole. Copies of a vector are kept once, with the smallest ids
    that can be in a result, as larger ids lose every tie. Members of a leaf are dealt in slices of
    4,096, and the queries that ask for a leaf in blocks of 8,192; a leaf's members are repeated for
    its own blocks only, and not at all if no query asks for it. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(column) & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(column).alias("v"), is_query.alias("asked")
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common.n if common else 0))

    first = Window.partitionBy("v").orderBy("id")
    fewest = rows.select("id", "v").distinct().withColumn("n", F.row_number().over(first))
    ids = F.array_sort(F.collect_list("id")).alias("ids")
    distinct = fewest.where(F.col("n") <= neighbours + 1).groupBy("v").agg(ids)
    distinct = checkpointed(distinct)
    forest = fit_forest(distinct, "v", neighbours=neighbours, **fit)
    shared = spark.sparkContext.broadcast(forest)
    kind = vectors.schema[id_column].dataType.simpleString()

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaves=list(shared.value.leaves(_unit(batch["v"]))))

    vector = vectors.schema[column].dataType.simpleString()
    schema = f"v {vector}, ids array<{kind}>, leaves array<int>"
    index = checkpointed(distinct.select("v", "ids").mapInPandas(locate, schema))
    placed = index.select("v", "ids", F.posexplode("leaves").alias("tree", "leaf"))
    asked = rows.where("asked").select("id", "v").distinct()
    questions = asked.count()
    # Few small rows with much work each: more partitions than their bytes call for.
    asked = asked.repartition(-(-questions // 128) or 1, "id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                taken = [list(shared.value.search(unit)) for unit in _unit(batch["v"])]
                trees, leaves = ([[place[k] for place in own] for own in taken] for k in (0, 1))
                yield batch.assign(trees=trees, leaves=leaves)

    walked = checkpointed(
        asked.mapInPandas(walk, f"id {kind}, v {vector}, trees array<int>, leaves array<int>")
    )
    walked = walked.select("id", "v", F.explode(F.arrays_zip("trees", "leaves")).alias("place"))
    walked = walked.select("id", "v", F.col("place.trees").alias("tree"), F.col("place.leaves").alias("leaf"))
    # One row per leaf of the forest at most, of which there are a fixed number.
    members_of = {(r.tree, r.leaf): r["count"] for r in placed.groupBy("tree", "leaf").count().collect()}
    queries_of = {(r.tree, r.leaf): r["count"] for r in walked.groupBy("tree", "leaf").count().collect()}
    plan = [
        (*key, -(-members_of[key] // _SLICE_ROWS), -(-count // _QUERY_ROWS))
        for key, count in queries_of.items()
        if key in members_of
    ]
    dealt = F.broadcast(spark.createDataFrame(plan, "tree int, leaf int, slices int, blocks int"))

    def place(of: str, count: str) -> Column:
        return F.pmod(F.xxhash64(of), F.col(count)).cast("int")

    every = F.sequence(F.lit(0), F.col("slices") - 1)
    wanted = walked.join(dealt, ["tree", "leaf"]).withColumn("block", place("id", "blocks"))
    wanted = wanted.withColumn("slice", F.explode(every))
    members = placed.join(dealt, ["tree", "leaf"]).withColumn("slice", place("ids", "slices"))
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def rank(key, questions: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        best: list[tuple] = []
        if len(questions) and len(found):
            m = np.stack(found["v"].to_list()).astype(np.float64)
            unit, ids = _unit(found["v"]), found["ids"].to_list()
            for at in range(0, len(questions), _ASKED_AT_ONCE):
                part = questions.iloc[at : at + _ASKED_AT_ONCE]
                best += _best_of_slice(part, m, unit, ids, neighbours)
        return pd.DataFrame(best, columns=["query_id", "vec_id", "score"])

    keys = ["tree", "leaf", "slice", "block"]
    pairs = (
        wanted.select(*keys, "id", "v")
        .groupBy(*keys)
        .cogroup(members.select(*keys, "v", "ids").groupBy(*keys))
        .applyInPandas(rank, f"query_id {kind}, vec_id {kind}, score double")
    )
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )
