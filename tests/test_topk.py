"""The top-k kernel against a plain loop over all pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from nearkin.operators import topk
from nearkin.operators.topk import TopK, group_position, route_index, to_matrix


def expected(queries, rows, ids, k, measure, allowed=None):
    out = []
    for q, query in enumerate(queries):
        scored = []
        for r, row in enumerate(rows):
            if allowed is not None and not allowed[q][r]:
                continue
            if measure == "euclidean":
                d = np.sqrt(((row - query) ** 2).sum())
            elif measure == "dot":
                d = -(row * query).sum()
            else:
                length = np.sqrt((row**2).sum()) * np.sqrt((query**2).sum())
                d = np.inf if length == 0 else 1 - (row * query).sum() / length
            scored.append((round(d, 9), ids[r]))
        out += [(q, i, d) for d, i in sorted(scored)[:k]]
    return out


def run(queries, rows, ids, k, measure, batch):
    best = TopK(queries, k, measure)
    for start in range(0, len(rows), batch):
        part = slice(start, start + batch)
        best.feed(pa.table({"id": ids[part]}), rows[part])
    return rows_of(best)


def rows_of(best):
    found = []
    for b in best.hits(pa.chunked_array([pa.array(range(len(best.vectors)))])):
        found += b.to_pylist()
    return [
        (r["query_id"], r["id"], np.inf if r["distance"] is None else round(r["distance"], 9))
        for r in found
    ]


@pytest.mark.parametrize("measure", topk.MEASURES)
@pytest.mark.parametrize("batch", [7, 600, 5000])
def test_equals_all_pairs(measure, batch):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2500, 12)) * rng.uniform(0.01, 30, size=(2500, 1))
    queries = rng.normal(size=(23, 12))
    ids = list(rng.permutation(2500))
    assert run(queries, rows, ids, 10, measure, batch) == expected(queries, rows, ids, 10, measure)


@pytest.mark.parametrize("measure", topk.MEASURES)
@pytest.mark.parametrize("kind", [int, str])
def test_copies_ties_and_zero_vectors(measure, kind):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 6))
    hot = np.repeat(base[:1], 900, axis=0)  # one vector holds a third of the rows
    near = base[1] + rng.normal(size=(900, 6)) * 1e-12
    rows = np.vstack([hot, near, np.zeros((300, 6)), rng.normal(size=(900, 6))])
    ids = [kind(i) for i in rng.permutation(len(rows)) + 10000]
    queries = np.vstack([base[0], base[1], np.zeros(6), rng.normal(size=(5, 6))])
    near_hits = [r for r in run(queries, rows, ids, 25, measure, 700) if r[0] != 1]
    # Distances to the near copies differ only in the last digits, so order among them is free.
    assert near_hits == [r for r in expected(queries, rows, ids, 25, measure) if r[0] != 1]


@pytest.mark.parametrize("scale", [1e-21, 1e-3, 1e18, 1e30])
def test_extreme_lengths(scale):
    rng = np.random.default_rng(3)
    rows, queries = rng.normal(size=(3000, 8)) * scale, rng.normal(size=(9, 8)) * scale
    ids = list(range(3000))
    for measure in topk.MEASURES:
        got = [(q, i) for q, i, _ in run(queries, rows, ids, 5, measure, 1000)]
        best = TopK(queries, 5, measure)
        d = np.stack([best._distance(*np.broadcast_arrays(best._operands(rows)[0], v)) for v in best.vectors])
        want = [(q, int(i)) for q in range(9) for i in np.argsort(d[q], kind="stable")[:5]]
        assert got == want


def test_candidates_beyond_the_single_precision_bound_are_measured_again():
    rng = np.random.default_rng(4)
    rows = 1.0 + rng.normal(size=(4000, 16)) * 1e-8  # indistinguishable in single precision
    query = np.ones((1, 16))
    got = run(query, rows, list(range(4000)), 5, "euclidean", 2000)
    d = np.sqrt(((rows - query) ** 2).sum(axis=1))
    assert [i for _, i, _ in got] == list(np.argsort(d)[:5])


def test_buckets_and_rows_reached_twice():
    rng = np.random.default_rng(5)
    rows, queries = rng.normal(size=(300, 5)), rng.normal(size=(6, 5))
    member = [["a", "b"] if i % 3 == 0 else ["b"] if i % 3 == 1 else None for i in range(300)]
    routed = [["a"], ["a", "b"], None, [], ["zzz"], ["b"]]
    table = pa.table({
        "id": list(range(300)),
        "_vector": pa.array(list(rows), pa.list_(pa.float64())),
        "_buckets": pa.array(member, pa.list_(pa.string())),
    })
    best = TopK(queries, 4, "cosine")
    routes = route_index(pa.array(routed, pa.list_(pa.string())))
    for start in (0, 100, 200):
        best.feed_routed(table.slice(start, 100), routes)
    allowed = [
        [r is None or bool(set(r) & set(m or [])) for m in member] for r in routed
    ]
    assert rows_of(best) == expected(queries, rows, list(range(300)), 4, "cosine", allowed)


def test_width_and_measure_are_checked():
    with pytest.raises(ValueError, match="measure"):
        TopK(np.ones((1, 2)), 1, "manhattan")
    with pytest.raises(ValueError, match="width"):
        TopK(np.ones((1, 2)), 1, "dot").feed(pa.table({"id": [1]}), np.ones((1, 3)))
    with pytest.raises(ValueError, match="width"):
        to_matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_small_helpers():
    assert list(group_position(np.array([3, 3, 5, 5, 5, 1]))) == [0, 1, 0, 1, 2, 0]
    free, index = route_index(pa.array([["x"], None, [], ["y", "x"], [None]], pa.list_(pa.string())))
    assert list(free) == [1]
    assert {k: list(v) for k, v in index.items()} == {"x": [0, 3], "y": [3]}


@pytest.mark.parametrize("measure", ["cosine", "euclidean"])
def test_memory_does_not_follow_the_rows_offered(measure):
    """Neither many rows nor rows that each beat the ones before make a task hold copies of them."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(60_000, 64))
    queries = rows[:300] + 0.1
    rows = rows[np.argsort(-np.abs(rows - queries[0]).sum(axis=1))]
    best = TopK(queries, 25, measure)
    tracemalloc.start()
    best.feed(pa.table({"id": np.arange(len(rows))}), rows)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best.hits(pa.chunked_array([np.arange(300)]))[0].num_rows == 300 * 25
    assert held < rows.nbytes
