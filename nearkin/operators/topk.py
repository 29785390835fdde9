"""Exact top-k of a block of queries against batches of rows, inside one task.

A batch is first multiplied with the queries in single precision; a row is kept
as a candidate only if the error bound of that product cannot rule it out.
Candidates are then measured pair by pair in double precision, so the result
does not depend on how rows were batched.  Ties go to the smaller key.

Beside the rows and queries given, a task holds ``HIT_BYTES`` for each of the ``k`` rows of a
query and some tens of megabytes of slices, whatever the number of rows offered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TILE = 1 << 20  # products held at once
WARM_UP = 1024  # rows of the first slice, from which the first bounds come
PAIR_CELLS = 1 << 20  # vector elements of candidate pairs held at once
PENDING = 1 << 16  # new hits held at once beyond as many as are in the result
HIT_BYTES = 200  # of a row of the result while new hits are sorted into it
QUERY_ROWS = 2048  # queries answered at once where they stream past the candidates
SLICE = 4096  # rows handled at once where a whole copy of the vectors would be needed
NO_VALUE = -1e30  # product of a row that has no cosine; finite, as matrix products want
MEASURES = ("cosine", "euclidean", "dot")


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a double matrix; all rows must have the same width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    widths = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or widths["min"] != widths["max"]:
        raise ValueError(f"vectors differ in width: {widths['min']} to {widths['max']}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(flat).all():
        raise ValueError("vectors hold null or non-finite elements")
    return flat.astype(np.float64, copy=False).reshape(len(column), widths["min"])


def route_index(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, dict]:
    """Positions of rows without a list, and the positions found under each element."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    free = np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False))
    owners = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    named = lists.flatten()
    valid = named.is_valid().to_numpy(zero_copy_only=False)
    owners, encoded = owners[valid], named.drop_null().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
    names = encoded.dictionary.to_pylist()
    return free, {n: owners[order[cuts[i] : cuts[i + 1]]] for i, n in enumerate(names)}


def by_slices(size: int, part: Callable[[slice], np.ndarray]) -> np.ndarray:
    """``part`` of all rows, put together from slices."""
    return np.concatenate([part(slice(at, at + SLICE)) for at in range(0, max(size, 1), SLICE)])


def row_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches in slices of as many queries as are answered at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, QUERY_ROWS):
            yield pa.Table.from_batches([batch.slice(at, QUERY_ROWS)])


def group_position(groups: np.ndarray) -> np.ndarray:
    """Place of each row within its run of equal, adjacent groups."""
    rows = np.arange(len(groups))
    starts = np.r_[True, groups[1:] != groups[:-1]] if len(groups) else np.empty(0, bool)
    return rows - np.maximum.accumulate(np.where(starts, rows, 0)) if len(groups) else rows


class TopK:
    """Running best ``k`` rows per query.

    Smaller is nearer: cosine distance, Euclidean distance, or the negative dot
    product.  Cosine has no value for a zero vector; it is kept as infinity here
    and leaves as null.
    """

    def __init__(self, queries: np.ndarray, k: int, measure: str):
        if measure not in MEASURES:
            raise ValueError(f"Unsupported measure: {measure}")
        self.k, self.measure = k, measure
        self.vectors, self.square, self.blank = self._operands(queries)
        self.bound = np.full(len(queries), -np.inf)
        self.best: pa.Table | None = None
        self.pending: list[pa.Table] = []
        self.pending_rows = 0

    def _operands(self, vectors):
        square = (vectors * vectors).sum(axis=1)
        if self.measure != "cosine":
            return vectors, square, np.zeros(len(vectors), bool)
        blank = square == 0
        unit = vectors / np.sqrt(np.where(blank, 1.0, square))[:, None]
        return unit, np.where(blank, 0.0, 1.0), blank

    def _closeness(self, distance, square):
        """Distance turned into the product it came from (larger is nearer)."""
        if self.measure == "cosine":
            return 1.0 - distance
        return -distance if self.measure == "dot" else (square - distance**2) / 2

    def feed(self, keys: pa.Table, vectors: np.ndarray, queries: np.ndarray | None = None):
        """Offer rows to all queries, or to those at the given positions.

        The first column of ``keys`` orders ties and must be unique in a call.
        """
        queries = np.arange(len(self.vectors)) if queries is None else queries
        if not len(vectors) or not len(queries):
            return
        if vectors.shape[1] != self.vectors.shape[1]:
            raise ValueError(
                f"expected vectors of width {self.vectors.shape[1]}, got {vectors.shape[1]}"
            )
        keep = self._without_surplus_copies(keys, vectors)
        if keep is not None:
            keys, vectors = keys.take(keep), vectors[keep]

        blank = queries[self.blank[queries]]
        if len(blank):
            first = pc.sort_indices(keys.column(0)).to_numpy()[: self.k]
            pairs = np.repeat(first, len(blank)), np.tile(blank, len(first))
            self._hold(keys, *pairs, np.full(len(pairs[0]), np.inf))
            queries = queries[~self.blank[queries]]

        start, size = 0, len(vectors)
        while start < size and len(queries):
            unfilled = np.isneginf(self.bound[queries]).any()
            stop = min(size, start + (WARM_UP if unfilled else max(WARM_UP, TILE // 2048)))
            rows = self._operands(vectors[start:stop])
            step = max(1, TILE // (stop - start))
            for first in range(0, len(queries), step):
                self._tile(keys.slice(start, stop - start), rows, queries[first : first + step])
            if self.pending_rows >= self.k * len(self.vectors):
                self._reduce()
            start = stop

    def _without_surplus_copies(self, keys, vectors):
        """Rows to keep when more than ``k`` are the same vector, else None.

        Only the ``k`` smallest keys among equal vectors can be in a result.
        """
        if len(vectors) <= self.k:
            return None
        weights = np.cos(np.arange(1, vectors.shape[1] + 1))
        mark = by_slices(len(vectors), lambda rows: (vectors[rows] * weights).sum(axis=1))
        _, group, counts = np.unique(mark, return_inverse=True, return_counts=True)
        if counts.max() <= self.k:
            return None
        place = np.empty(len(vectors), np.int64)
        place[pc.sort_indices(keys.column(0)).to_numpy()] = np.arange(len(vectors))
        order = np.lexsort((place, group))
        head = order[np.flatnonzero(group_position(group[order]) == 0)]
        first = head[group]
        same = by_slices(len(vectors), lambda rows: (vectors[rows] == vectors[first[rows]]).all(axis=1))
        surplus = group_position(group[order]) >= self.k
        # A row whose mark is shared by chance is always kept.
        mixed = np.bincount(group, ~same, len(counts)) > 0
        return np.sort(order[~surplus | mixed[group[order]]])

    def _tile(self, keys, rows, queries):
        vectors, square, blank = rows
        width = vectors.shape[1]
        large = max(square.max(initial=0), self.square[queries].max(initial=0)) > 1e30
        for kind in (np.float64,) if large else (np.float32, np.float64):
            slack = (width + 16) * np.finfo(kind).eps
            row_error = 2 * slack * square + 8 * width * np.finfo(kind).tiny
            bias = row_error - (square / 2 if self.measure == "euclidean" else 0.0)
            left = np.c_[self.vectors[queries], np.ones(len(queries))].astype(kind)
            right = np.c_[vectors, np.where(blank, NO_VALUE, bias)].astype(kind)
            product = left @ right.T
            own = self.square[queries]
            floor = self.bound[queries] - 2 * slack * own
            if self.measure == "euclidean":
                floor -= slack * np.where(np.isneginf(floor), 0, own - 2 * self.bound[queries])
            open_ = np.isneginf(floor)
            if open_.any() and len(vectors) > self.k:
                cut = len(vectors) - self.k
                kth = np.partition(product[open_], cut, axis=1)[:, cut].astype(np.float64)
                floor[open_] = kth - 2 * row_error.max() - 4 * slack * own[open_]
            with np.errstate(over="ignore"):
                floor = np.nextafter(floor.astype(kind), kind(-np.inf))
            hit = product >= floor[:, None]
            if kind is np.float64 or np.count_nonzero(hit) <= 8 * self.k * len(queries):
                break
        query, row = np.nonzero(hit)
        chunk = max(1, PAIR_CELLS // width)
        for start in range(0, len(row), chunk):
            r, q = row[start : start + chunk], queries[query[start : start + chunk]]
            distance = self._distance(vectors[r], self.vectors[q])
            self._hold(keys, r, q, np.where(blank[r], np.inf, distance))
            if self.pending_rows > self.k * len(self.vectors) + PENDING:
                self._reduce()

    def _distance(self, a, b):
        if self.measure == "euclidean":
            return np.sqrt(((a - b) ** 2).sum(axis=1))
        product = (a * b).sum(axis=1)
        return 1.0 - product if self.measure == "cosine" else -product

    def _hold(self, keys, rows, queries, distance):
        found = {"_query": pa.array(queries.astype(np.int32)), "_distance": pa.array(distance)}
        for name in keys.column_names:
            found[name] = keys.column(name).take(pa.array(rows))
        self.pending.append(pa.table(found))
        self.pending_rows += len(rows)

    def _reduce(self):
        if not self.pending:
            return
        if self.best is not None:
            self.pending.append(self.best)
        merged = pa.concat_tables(self.pending).combine_chunks()
        self.best, self.pending, self.pending_rows = None, [], 0  # what was merged goes
        key = merged.column_names[2]
        query, distance = (merged.column(i).to_numpy() for i in (0, 1))
        names = merged.column(key).combine_chunks()
        if pa.types.is_integer(names.type):
            place = names.to_numpy()
        else:
            place = pc.rank(names, tiebreaker="dense").to_numpy()
        order = np.lexsort((place, distance, query))
        # A row reached through two buckets stands next to its copy: same query, distance, key.
        query, distance, place = query[order], distance[order], place[order]
        repeat = np.zeros(len(query), bool)
        repeat[1:] = (query[1:] == query[:-1]) & (distance[1:] == distance[:-1]) & (place[1:] == place[:-1])
        kept = np.flatnonzero(~repeat)
        position = group_position(query[kept])
        inside = position < self.k
        kept, position = kept[inside], position[inside]
        self.best = merged.take(pa.array(order[kept]))
        last = kept[position == self.k - 1]
        filled = query[last]
        self.bound[filled] = self._closeness(distance[last], self.square[filled])

    def feed_routed(
        self, table: pa.Table, routes: tuple[np.ndarray, dict], buckets: tuple[np.ndarray, dict] | None = None
    ):
        """Offer rows with ``_vector`` and ``_buckets`` to the queries routed to them.

        ``buckets`` is the index of the rows' buckets, where it is known already.
        """
        free, by_bucket = routes
        keys = table.drop_columns(["_vector", "_buckets"])
        vectors = to_matrix(table.column("_vector"))
        self.feed(keys, vectors, free)
        if by_bucket:
            for name, rows in (buckets or route_index(table.column("_buckets")))[1].items():
                if name in by_bucket:
                    self.feed(keys.take(pa.array(rows)), vectors[rows], by_bucket[name])

    def _finish(self) -> pa.Table | None:
        self._reduce()
        if self.best is None:
            return None
        distance = self.best.column("_distance").combine_chunks()
        distance = pc.if_else(pc.is_inf(distance), pa.scalar(None, pa.float64()), distance)
        return self.best.set_column(1, "_distance", distance)

    def hits(self, query_ids: pa.ChunkedArray) -> list[pa.RecordBatch]:
        """The result as ``(query_id, key, other columns, distance)``."""
        best = self._finish()
        if best is None:
            return []
        names = best.column_names[2:]
        columns = [query_ids.take(best.column("_query")), *[best.column(n) for n in names],
                   best.column("_distance")]
        found = pa.table(columns, names=["query_id", *names, "distance"])
        return found.combine_chunks().to_batches()

    def ranks(self) -> np.ndarray:
        """The 1-based rank of each row of ``hits``."""
        return group_position(self.best.column("_query").to_numpy()) + 1

    def label_lists(self, name: str, kind: pa.DataType) -> pa.Array:
        """One list per query with a column of its rows, nearest first."""
        best = self._finish()
        if best is None:
            labels, counts = pa.array([], kind), np.zeros(len(self.vectors), np.int64)
        else:
            labels = best.column(name).combine_chunks()
            counts = np.bincount(best.column("_query").to_numpy(), minlength=len(self.vectors))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, counts.cumsum()].astype(np.int32)), labels)
