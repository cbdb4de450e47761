"""Problem 7: items of uneven length into containers of fixed capacity.

Lengths are planned as a histogram, never item by item, so the plan has the same size for a
thousand and for a trillion items:

1. Lengths are put into windows of ``width`` tokens. Every combination of up to ``depth`` windows
   whose upper ends sum to the capacity is a column; non-negative least squares (active set) finds
   how often to use each so that the columns add up to the histogram.
2. The counts are rounded down and items given to the columns' slots by exact length.
3. What is left (rounding, short items) is packed greedily, longest first, each length into the
   containers with the least space that still takes it, again as counts.

Each item finds its container from its rank among the items of its length; ranks are taken within
(length, salt), so a length with a third of all items is spread over ``SALTS`` tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import stage

SALTS = 64


def combinations(total: int, depth: int) -> np.ndarray:
    """Rows of up to ``depth`` window numbers, largest first, that sum to ``total``; 0 fills up."""
    rows: list[np.ndarray] = []
    for n in range(1, depth + 1):
        part = np.arange(1, total + 1)[:, None]
        for k in range(1, n):  # the next part is at most the last one
            if k == n - 1:
                rest = total - part.sum(1)
                part = np.hstack([part, rest[:, None]])[(rest >= 1) & (rest <= part[:, -1])]
            else:
                nxt = [np.hstack([part[part[:, -1] >= v], np.full(((part[:, -1] >= v).sum(), 1), v)]) for v in range(1, total)]
                part = np.vstack(nxt)
                part = part[part.sum(1) + (n - k - 1) <= total]
        part = part[part.sum(1) == total]
        rows.append(np.pad(part, ((0, 0), (0, depth - n))))
    return np.vstack(rows).astype(np.int32)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int) -> dict[int, float]:
    """Active-set non-negative least squares. ``columns`` holds row numbers (0: none) of each
    column's entries; ``target[0]`` is unused. Gives column -> value of those above 0."""
    rows = len(target)
    chosen: list[int] = []
    x = np.zeros(0)
    a = np.zeros((rows, 0))
    residual = target.astype(float).copy()
    residual[0] = 0
    scale = max(1.0, float(target.max()))
    for _ in range(rounds):
        gain = residual[columns].sum(1)  # residual[0] is 0, so empty slots add nothing
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-9 * scale:
            break
        col = np.bincount(columns[best], minlength=rows).astype(float)
        col[0] = 0
        chosen.append(best)
        a = np.hstack([a, col[:, None]])
        x = np.append(x, 0.0)
        while chosen:
            z = np.linalg.lstsq(a, target, rcond=None)[0]
            if (z > 1e-9).all():
                x = z
                break
            bad = z <= 1e-9
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.min(np.where(bad, x / np.maximum(x - z, 1e-300), np.inf))
            x = x + min(1.0, max(0.0, step)) * (z - x)
            keep = x > 1e-9
            if keep.all():
                keep[np.argmin(np.where(bad, x, np.inf))] = False
            chosen = [c for c, k in zip(chosen, keep) if k]
            a, x = a[:, keep], x[keep]
        residual = target - a @ x if chosen else target.astype(float).copy()
        residual[0] = 0
    return dict(zip(chosen, x))


class Plan:
    """Containers for a histogram: for each length, from which rank on which containers."""

    def __init__(self, counts: np.ndarray, capacity: int, width: int = 16, depth: int = 3) -> None:
        self.capacity = capacity
        self.intervals: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.used = np.zeros(capacity + 1, np.int64)
        self.containers = 0
        #: space -> segments (first container, containers); and the spaces there are, in order
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []
        counts = counts.astype(np.int64)
        if counts[1:].sum():
            self._columns(counts, width, depth)
            self._greedy(counts)

    def _give(self, length: int, n: int, first: int) -> None:
        """The next n items of this length into containers first, first + 1, ..."""
        self.intervals[length].append((int(self.used[length]), first))
        self.used[length] += n

    def _leave(self, space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in self.open:
                insort(self.spaces, space)
            self.open.setdefault(space, []).append((first, n))

    def _columns(self, counts: np.ndarray, width: int, depth: int) -> None:
        total = self.capacity // width
        window = -(-np.arange(self.capacity + 1) // width)
        target = np.bincount(window, weights=counts, minlength=total + 1)[: total + 1]
        target[0] = 0
        cols = combinations(total, depth)
        solved = nnls(cols, target, rounds=3 * total)
        left = target.astype(np.int64)
        at = {w: w * width for w in range(total + 1)}  #: the length that a window gives next
        for c, v in sorted(solved.items(), key=lambda kv: (-kv[1], kv[0])):
            parts = cols[c][cols[c] > 0]
            need = np.bincount(parts, minlength=total + 1)
            n = int(min([np.floor(v + 1e-6), *(left[w] // need[w] for w in set(parts.tolist()))]))
            if n <= 0:
                continue
            left -= need * n
            first, cuts, runs = self.containers, {0, n}, []
            for w in parts.tolist():
                todo, done = n, 0
                while todo:
                    length = at[w]
                    here = int(min(todo, counts[length] - self.used[length]))
                    if here <= 0:
                        at[w] -= 1
                        continue
                    self._give(length, here, first + done)
                    runs.append((done, done + here, length))
                    done, todo = done + here, todo - here
                    cuts.add(done)
            self.containers += n
            edges = sorted(cuts)
            for a, b in zip(edges, edges[1:]):
                self._leave(self.capacity - sum(x for s, e, x in runs if s <= a and b <= e), first + a, b - a)

    def _greedy(self, counts: np.ndarray) -> None:
        for length in range(self.capacity, 0, -1):
            todo = int(counts[length] - self.used[length])
            while todo:
                k = bisect_left(self.spaces, length)
                if k < len(self.spaces):
                    space = self.spaces[k]
                    first, n = self.open[space].pop()
                    if not self.open[space]:
                        del self.open[space]
                        self.spaces.pop(k)
                    here = min(n, todo)
                    self._give(length, here, first)
                    self._leave(space - length, first, here)
                    self._leave(space, first + here, n - here)
                    todo -= here
                else:
                    here = -(-todo // (self.capacity // length))
                    self._leave(self.capacity, self.containers, here)
                    self.containers += here

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys length * 2**48 + rank, the containers they begin with, and their ranks."""
        rows = [(length, rank, first) for length, got in enumerate(self.intervals) for rank, first in got]
        t = np.asarray(rows, np.int64).reshape(-1, 3)
        return (t[:, 0] << 48) + t[:, 1], t[:, 2], t[:, 1]


def pack(items: DataFrame, capacity: int = 4096, width: int = 16, depth: int = 3) -> DataFrame:
    """doc_id, piece_no, start_token, n_tokens, container_id for ``items`` (doc_id, n_tokens).

    An item beyond the capacity is divided into full pieces and a rest, others never. Items of
    length 0 or null length take no space: one row, with n_tokens 0 and a null container. Repeated
    rows are items of their own. An empty table gives an empty result. Containers count from 0."""
    spark = items.sparkSession
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint")
    items = items.select(F.col("doc_id"), n.alias("n"))
    pieces = items.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece_no", "k"))
    pieces = pieces.select(
        "doc_id",
        F.col("piece_no").cast("bigint").alias("piece_no"),
        (F.col("k") * F.lit(capacity).cast("bigint")).alias("start_token"),
        F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("k") * F.lit(capacity).cast("bigint")).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(SALTS)).alias("salt"),
    )
    pieces = stage(pieces, "pieces")
    # at most (capacity + 1) x SALTS rows reach the driver
    got = pieces.groupBy("n_tokens", "salt").count().toPandas()
    grid = np.zeros((capacity + 1, SALTS), np.int64)
    grid[got["n_tokens"].to_numpy(np.int64), got["salt"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    plan = Plan(grid.sum(1), capacity, width, depth)
    keys, first, rank0 = plan.tables()
    before = np.cumsum(grid, 1) - grid
    shared = spark.sparkContext.broadcast((keys, first, rank0, before))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, first, rank0, before = shared.value
        for b in batches:
            length, salt, row = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4, 5))
            rank = before[length, salt] + row - 1
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            ok = length > 0
            c = np.where(ok, first[at] + rank - rank0[at], -1) if len(keys) else np.full(len(length), -1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(c, pa.int64(), mask=~ok)], ["doc_id", "piece_no", "start_token", "n_tokens", "container_id"])

    w = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")
    ranked = pieces.select("doc_id", "piece_no", "start_token", "n_tokens", "salt", F.row_number().over(w).alias("row"))
    return ranked.mapInArrow(place, "doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint, container_id bigint")


def packing_summary(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, items, tokens, and the share of the space that is filled."""
    per = packed.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        F.round(F.sum("t") / (F.count("*") * capacity), 6).alias("filled"),
    )
