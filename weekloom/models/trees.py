"""Random forests of all groups at once: histogram trees grown level by level, all targets together.

Rows carry their features as bins, cut at quantiles of the group's train rows. For a level, every task adds up
count and target sums of its rows by (group, tree, node, feature, bin); one shuffle by (group, tree, node) brings
them together, and the best cut of each node is found where they meet. A split lowers the squared error summed over the targets,
as one joint multi-output tree does. What is shuffled is sums, what reaches the driver is nodes: at most
``NODES`` of them at a time, as groups beyond that grow in a later round. A group with a large share of
the rows is spread over all tasks.

Bootstrap counts and feature choices come from whole-number arithmetic on (row, tree) and (tree, node, feature), so
they do not depend on how rows are split over tasks, and any engine can repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.session import stage

PRIME = (1 << 31) - 1
#: Nodes of all trees that are grown together.
NODES = 1_500_000
#: Rank error of the cuts; up to half as many rows of a group are cut exactly.
ACCURACY = 100_000
#: A Poisson(1) variable is the number of these that a uniform number of 31 bits exceeds.
POISSON = [int(PRIME * exp(-1) * sum(1 / factorial(i) for i in range(k + 1))) for k in range(8)]
DECIMALS = 6


def scrambled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number below PRIME for each pair of numbers below PRIME."""
    x = (a * 48271 + b * 69621 + 12345) % PRIME
    return (x * x % PRIME * 16807 + b) % PRIME


def bootstrap(row: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    return np.searchsorted(POISSON, scrambled(row, np.int64(tree)), "left")


def chosen(tree: int, nodes: np.ndarray, features: int, size: int) -> np.ndarray:
    """The features that each node may be cut by, in ascending order."""
    a = (tree * 4099 + nodes[:, None]) % PRIME
    order = np.argsort(scrambled(a, 1000 + np.arange(features)[None, :]), axis=1, kind="stable")
    return np.sort(order[:, :size], axis=1)


@dataclass(frozen=True)
class Shape:
    trees: int
    depth: int
    bins: int
    features: int
    targets: int
    tried: int  # features that a node may be cut by

    @property
    def nodes(self) -> int:
        return (2 << self.depth) - 1


@dataclass(frozen=True)
class Forest:
    """Trees of a round's groups: feature (-1 in leaves) and highest bin to the left, and the mean of every node."""

    shape: Shape
    feature: np.ndarray
    cut: np.ndarray
    mean: np.ndarray | None

    @staticmethod
    def empty(shape: Shape, groups: int) -> Forest:
        size = (groups, shape.trees, shape.nodes)
        mean = np.zeros((*size, shape.targets))
        return Forest(shape, np.full(size, -1, np.int16), np.zeros(size, np.uint8), mean)

    def at(self, group: int, tree: int, bins: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Node of each row after so many levels, and whether it is on that level (and not a leaf above)."""
        node, on = np.zeros(len(bins), np.int64), np.ones(len(bins), bool)
        feature, cut = self.feature[group, tree], self.cut[group, tree]
        every = np.arange(len(bins))
        for _ in range(levels):
            f = feature[node]
            on &= f >= 0
            node = np.where(on, 2 * node + 1 + (bins[every, f] > cut[node]), node)
        return node, on


def row_number(product: Column, day: Column) -> Column:
    """A number below PRIME that stands for a row in ``bootstrap``."""
    days = F.datediff(day, F.lit("1970-01-01").cast("date"))
    return F.pmod(F.pmod(product, F.lit(PRIME)) * 613 + days, F.lit(PRIME)).cast("long")


def statistics(train: DataFrame, features: list[str], bins: int) -> DataFrame:
    """Per group ``g``: train means, and cuts at the quantiles of the train rows."""
    share = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    return train.groupBy("g").agg(
        F.array(*[F.avg(c) for c in features]).alias("means"),
        F.array(
            *[F.percentile_approx(F.round(F.col(c).cast("double"), DECIMALS), share, ACCURACY) for c in features]
        ).alias("cuts"),
    )


def _fixed(column: pa.Array, width: int, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(-1, width)


def coded(rows: DataFrame, stats: list, shape: Shape, keep: list[str]) -> DataFrame:
    """Rows (``g``, ``x`` features with nulls, ``keep``) with group number ``k`` and ``bins``; nulls are the train mean."""
    order = {s["g"]: i for i, s in enumerate(stats)}
    means = [np.array(s["means"], float) for s in stats]
    cuts = [[np.unique(np.array(c, float)) for c in s["cuts"]] for s in stats]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.array([order[g] for g in batch.column("g").to_pylist()], np.int32)
            x = _fixed(batch.column("x"), shape.features, float)
            out = np.empty(x.shape, np.int32)
            for i in np.unique(k):
                at = k == i
                own = np.round(np.where(np.isnan(x[at]), means[i], x[at]), DECIMALS)
                out[at] = np.column_stack([np.searchsorted(c, own[:, f], "left") for f, c in enumerate(cuts[i])])
            size = np.arange(0, out.size + 1, shape.features, dtype=np.int32)
            bins = pa.ListArray.from_arrays(pa.array(size), pa.array(out.ravel().astype(np.int16)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), bins, *(batch.column(c) for c in keep)], names=["k", "bins", *keep]
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join(["k int", "bins array<smallint>", *(f"`{c}` {kinds[c]}" for c in keep)])
    return rows.mapInArrow(code, schema)


def _sums(forest: Forest, level: int):
    """Partial sums of a task: per node the cells (feature slot x bin) with count and target sums."""
    shape = forest.shape
    wide = shape.tried * shape.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column("k").to_numpy()
            all_bins = _fixed(batch.column("bins"), shape.features, np.int16)
            ys, row = _fixed(batch.column("y"), shape.targets, float), batch.column("row").to_numpy()
            for k in np.unique(ks):
                own = ks == k
                bins, y, rows = all_bins[own], ys[own], row[own]
                for tree in range(shape.trees):
                    weight = bootstrap(rows, tree)
                    node, on = forest.at(k, tree, bins, level)
                    some = np.flatnonzero(on & (weight > 0))
                    if not len(some):
                        continue
                    w, (present, local) = weight[some].astype(float), np.unique(node[some], return_inverse=True)
                    tried = chosen(tree, present, shape.features, shape.tried)[local]
                    cell = local[:, None] * wide + np.arange(shape.tried) * shape.bins + bins[some[:, None], tried]
                    parts = [w, *(w * y[some, t] for t in range(shape.targets))]
                    dense = np.stack(
                        [np.bincount(cell.ravel(), np.repeat(p, shape.tried), len(present) * wide) for p in parts], 1
                    )
                    full = np.flatnonzero(dense[:, 0])
                    ends = np.searchsorted(full // wide, np.arange(len(present) + 1)).astype(np.int32)
                    values = pa.array(dense[full].ravel())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((np.int64(k) * shape.trees + tree) * shape.nodes + present),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array((full % wide).astype(np.int32))),
                            pa.ListArray.from_arrays(pa.array(ends * len(parts)), values),
                        ],
                        names=["node", "cell", "sums"],
                    )

    return run


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold all rows of their nodes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy()
        last = int(np.searchsorted(node, node[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column("node")[0].as_py() != node[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _cuts(shape: Shape):
    """The best cut of each node: (node, feature or -1, cut, own mean, means to the left and right)."""
    wide, width = shape.tried * shape.bins, 1 + shape.targets

    def best(node: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        grid = sums.reshape(len(node), shape.tried, shape.bins, width)
        left = np.cumsum(grid, axis=2)
        whole = left[:, :1, -1:, :]
        right = whole - left
        with np.errstate(all="ignore"):
            gain = sum(
                (s[..., 1:] ** 2).sum(-1) / s[..., 0] * sign for s, sign in ((left, 1), (right, 1), (whole, -1))
            )
        gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0.5), np.round(gain, DECIMALS), -1.0)
        flat = gain.reshape(len(node), wide)
        at = flat.argmax(1)
        every, slot, cut = np.arange(len(node)), at // shape.bins, at % shape.bins
        tree = node // shape.nodes % shape.trees
        tried = np.stack([chosen(t, n[None], shape.features, shape.tried)[0] for t, n in zip(tree, node % shape.nodes)])
        good = flat[every, at] > 0
        l, r, w = left[every, slot, cut], right[every, slot, cut], whole[:, 0, 0]
        mean = lambda s: s[:, 1:] / np.maximum(s[:, :1], 1.0)
        values = np.concatenate([mean(w), mean(l), mean(r)], 1)
        ends = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(node),
                pa.array(np.where(good, tried[every, slot], -1).astype(np.int32)),
                pa.array(cut.astype(np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(values.ravel())),
            ],
            names=["node", "feature", "cut", "means"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_nodes(batches):
            node, cell, sums = (table.column(c).combine_chunks() for c in ("node", "cell", "sums"))
            present, local = np.unique(node.to_numpy(), return_inverse=True)
            size = np.diff(cell.offsets.to_numpy())
            cells = cell.flatten().to_numpy()
            values = sums.flatten().to_numpy().reshape(-1, width)
            local = np.repeat(local, size)
            for low in range(0, len(present), 512):
                some = (local >= low) & (local < low + 512)
                part = present[low : low + 512]
                index = (local[some] - low) * wide + cells[some]
                dense = np.stack([np.bincount(index, values[some, j], len(part) * wide) for j in range(width)], 1)
                yield best(part, dense)

    return run


def grow(train: DataFrame, shape: Shape, groups: int) -> Forest:
    """Forests of ``groups`` from staged rows (``k``, ``bins``, ``row``, ``y``)."""
    forest, context = Forest.empty(shape, groups), train.sparkSession.sparkContext
    for level in range(shape.depth):
        # Only cuts are needed to find the rows of a node.
        shared = context.broadcast(replace(forest, mean=None))
        sums = train.select("k", "bins", "row", "y").mapInArrow(
            lambda batches: _sums(shared.value, level)(batches), "node bigint, cell array<int>, sums array<double>"
        )
        cuts = (
            sums.repartition("node")
            .sortWithinPartitions("node")
            .mapInArrow(_cuts(shape), "node bigint, feature int, cut int, means array<double>")
            .toArrow()
        )
        shared.destroy()
        if not cuts.num_rows:
            break
        node, feature = cuts.column("node").to_numpy(), cuts.column("feature").to_numpy()
        means = _fixed(cuts.column("means").combine_chunks(), 3 * shape.targets, float)
        where = np.unravel_index(node, forest.feature.shape)
        forest.feature[where], forest.cut[where] = feature, cuts.column("cut").to_numpy()
        if level == 0:
            forest.mean[where] = means[:, : shape.targets]
        split = feature >= 0
        k, tree, at = (w[split] for w in where)
        for side in (1, 2):
            forest.mean[k, tree, 2 * at + side] = means[split, side * shape.targets : (side + 1) * shape.targets]
        if not split.any():
            break
    return forest


def predicted(rows: DataFrame, forest: Forest, counts: tuple[int, ...], keep: list[str]) -> DataFrame:
    """``p``: the targets' means over the first trees, for each number of trees in ``counts`` in turn."""
    shared, shape = rows.sparkSession.sparkContext.broadcast(forest), forest.shape
    width = len(counts) * shape.targets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ks = batch.column("k").to_numpy()
            all_bins = _fixed(batch.column("bins"), shape.features, np.int16)
            out = np.zeros((len(ks), len(counts), shape.targets))
            for k in np.unique(ks):
                own = ks == k
                total = np.zeros((own.sum(), shape.targets))
                for tree in range(max(counts)):
                    node, _ = model.at(k, tree, all_bins[own], shape.depth)
                    total += model.mean[k, tree, node]
                    for i in (i for i, c in enumerate(counts) if c == tree + 1):
                        out[own, i] = total / counts[i]
            ends = pa.array(np.arange(0, out.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))],
                names=[*keep, "p"],
            )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "p array<double>"]))


def forecast(
    frame: DataFrame, features: list[str], targets: list[str], shape: Shape, counts: tuple[int, ...], keep: list[str]
) -> Iterator[DataFrame]:
    """Predictions for the validation rows of staged ``frame``, one frame for each round of groups.

    ``frame`` has the group ``g``, ``row``, ``split``, features, targets and ``keep``. Groups without train rows have no
    forest and no predictions.
    """
    train, valid = frame.where("split = 'train'"), frame.where("split = 'valid'")
    stats = stage(statistics(train, features, shape.bins), "forest-stats")
    # The groups are model names, a list the driver has to loop over in any case.
    groups = [r["g"] for r in stats.select("g").orderBy("g").collect()]
    some = max(1, NODES // (shape.trees * shape.nodes))
    for at in range(0, len(groups), some):
        own = groups[at : at + some]
        picked = F.col("g").isin(own)
        found = stats.where(picked).orderBy("g").collect()
        x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
        y = F.array(*[F.col(c).cast("double") for c in targets]).alias("y")
        codes = coded(train.where(picked).select("g", x, "row", y), found, shape, ["row", "y"])
        forest = grow(stage(codes, "forest-codes"), shape, len(own))
        codes = coded(valid.where(picked).select("g", x, *keep), found, shape, keep)
        yield predicted(codes, forest, counts, keep)
