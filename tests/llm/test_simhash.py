from __future__ import annotations

import numpy as np
import pytest
import xxhash

from labreports.llm import simhash
from labreports.llm.components import connected_components
from labreports.llm.simhash import close_pairs, fingerprint, fingerprint_links, near_duplicates


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    """Smallest position reachable over links of at most two differing bits."""
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if (x ^ y).bit_count() <= 2 and root[j] > root[i]:
                    root[j], changed = root[i], True
    return root


@pytest.mark.parametrize("text", ["", "A", "a B", "x y z", "É b c d É b c", "w " * 70_000 + "end"])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_small_documents(small_documents):
    rows = small_documents.select("doc_id", "text").orderBy("doc_id").collect()
    values = [plain_fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    expected = {
        doc: (f"{value:016x}", ids[root])
        for doc, value, root in zip(ids, values, plain_components(values))
    }
    got = near_duplicates(small_documents).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == expected


def clustered(count):
    """Fingerprints of which many differ in few bits, in chains."""
    random = np.random.default_rng(0)
    values = [int(random.integers(0, 2**63))]
    for _ in range(count):
        value = values[int(random.integers(len(values)))]
        for bit in random.integers(0, 64, int(random.integers(1, 5))):
            value ^= 1 << int(bit)
        values.append(value)
    return list(dict.fromkeys(values))


def test_pivots_keep_every_close_pair():
    bits = np.array(clustered(300), np.uint64)
    left, right = close_pairs(bits)
    assert all(int(bits[i] ^ bits[j]).bit_count() <= 2 for i, j in zip(left, right))
    root = list(range(len(bits)))
    for _ in range(len(bits)):
        for i, j in zip(left, right):
            root[i] = root[j] = min(root[i], root[j])
    groups = plain_components([int(b) for b in bits])
    assert len(set(root)) == len(set(groups))


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_large_cells_give_the_same_components(spark, cell_rows):
    values = clustered(150)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), cell_rows)
    found = {r.node: r.root for r in connected_components(links).collect()}
    groups = {}
    for value, root in zip(signed, plain_components(values)):
        groups.setdefault(root, set()).add(found.get(value, value))
    assert all(len(group) == 1 for group in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.root for r in connected_components(frame).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}
    assert connected_components(frame.limit(0)).count() == 0


def test_odd_rows(odd):
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(odd).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 1)]
    assert near_duplicates(odd.limit(0)).count() == 0


def test_radius_is_two():
    assert simhash.RADIUS == 2 and sum(size for _, size in simhash.BANDS) == 64
