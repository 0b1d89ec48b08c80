"""Gradient boosting of leaf-wise trees over histograms of gradients and Hessians.

Features are cut into bins once. To split a leaf, only sums per (leaf, feature, bin) are needed; each task adds up its rows with
array operations, the sums are added across tasks by one small aggregate, and the driver sees a table whose size is
leaves x features x bins, whatever the number of rows. Always the leaf with the largest gain is split next. So that this does not cost
a job per leaf, a pass computes the sums of all leaves that may come next; of two children only the smaller one is read, the other
is what is left of its parent. A tree takes about as many passes as it has levels.

Gradients are rounded to multiples of 2**-20 and added as whole numbers: the sums, and so the trees, do not depend on how rows are
distributed. Rows are blocks of arrays that stay in memory (or on the executors' disks) between passes. Every tree brings their raw
scores up to date once, and they are written every ``STORE`` trees, so a lost executor costs a few trees at most.

A missing value is in a bin of its own before all others. Rows without a label take no part.
"""

from __future__ import annotations

import json
import math
import operator
import sys
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.sources.workspace import materialize

# What the workers run travels with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = 1 << 20
STORE = 10
ACCURACY = 20_000
#: Improvements of the held-out loss below this are none.
TOLERANCE = 1e-7


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    learning_rate: float = 0.1
    leaves: int = 31
    l2: float = 0.0
    bins: int = 64
    min_rows: int = 20
    patience: int = 10


@dataclass
class Tree:
    """Nodes by number; ``feature`` is -1 in a leaf. Rows whose bin is below ``at`` go left."""

    feature: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, empty in ((self.feature, -1), (self.at, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of a matrix of bins."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.at, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            here = node[rows]
            below = bins[rows, feature[here]] < at[here]
            node[rows] = np.where(below, left[here], right[here])
        return node

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Model:
    features: tuple[str, ...]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        found = json.loads(text)
        return Model(tuple(found["features"]), found["cuts"], found["base"], [Tree(**t) for t in found["trees"]])


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """For each feature its different quantiles, close to equal shares; a value belongs to the bin of the last cut up to it.

    All are found in one pass, in sketches of bounded size, which are exact up to ``ACCURACY`` rows.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, F.lit(ACCURACY)).alias(c) for c in features]).first()
    return [sorted(set(row[c] or [])) for c in features]


def _binned(columns: Sequence[pa.Array], cuts: Sequence[Sequence[float]]) -> np.ndarray:
    out = np.zeros((len(columns[0]), len(cuts)), np.uint8)
    for k, (column, borders) in enumerate(zip(columns, cuts, strict=True)):
        known = np.asarray(column.is_valid())
        values = column.fill_null(0.0).to_numpy(zero_copy_only=False)
        out[:, k] = np.where(known, np.searchsorted(np.array(borders), values, side="right") + 1, 0)
    return out


#: Rows of one Arrow batch: their bins, a byte per feature, and one array per column.
BLOCK = "_bins binary, _label binary, _weight binary, _held binary, _raw binary"
Block = tuple[bytes, bytes, bytes, bytes, bytes]


def binned_blocks(df: DataFrame, features: Sequence[str], cuts: list[list[float]], label: Column, weight: Column, held: Column) -> DataFrame:
    """The rows as blocks of arrays, with raw scores of 0."""
    rows = df.select(
        label.cast("double").alias("_label"), weight.cast("double").alias("_weight"), held.alias("_held"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.asarray(c.to_numpy(zero_copy_only=False), t).tobytes() for c, t in zip(b.columns, (np.float64, np.float64, np.bool_))]
            block = [_binned(b.columns[3:], cuts).tobytes(), *own, np.zeros(b.num_rows).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], ["_bins", "_label", "_weight", "_held", "_raw"])

    return rows.mapInArrow(run, BLOCK)


def _arrays(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins, label, weight, held, raw = block
    numbers = (np.frombuffer(x, t) for x, t in ((label, np.float64), (weight, np.float64), (held, np.bool_), (raw, np.float64)))
    return np.frombuffer(bins, np.uint8).reshape(-1, width), *numbers


def _read(stored: DataFrame) -> RDD:
    return stored.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def gradients(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, in units."""
    p = 1 / (1 + np.exp(-raw))
    return np.rint(weight * (p - label) * UNIT), np.rint(weight * p * (1 - p) * UNIT)


def _loss(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> int:
    return int(np.rint(weight * (np.logaddexp(0, raw) - label * raw) * UNIT).sum())


def _sums(blocks: RDD, tree: Tree, wanted: list[int], width: int, bins: int) -> tuple[dict[int, np.ndarray], int]:
    """Per wanted node an array (3, features, bins) of gradients, Hessians and rows; and the loss of the held-out rows."""
    slots = width * (bins + 1)

    def run(part: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        total, loss = np.zeros((3, len(wanted) * slots), np.int64), 0
        place = np.full(len(tree.feature), -1)
        place[wanted] = np.arange(len(wanted))
        for block in part:
            matrix, label, weight, held, raw = _arrays(block, width)
            if wanted == [0]:
                loss += _loss(raw[held], label[held], weight[held])
            at = place[tree.nodes(matrix)]
            use = (at >= 0) & ~held
            g, h = gradients(raw[use], label[use], weight[use])
            slot = (at[use, None] * slots + np.arange(width) * (bins + 1) + matrix[use]).ravel()
            for k, values in enumerate((g, h, np.ones(len(g)))):
                # Whole numbers below 2**53 are added exactly.
                total[k] += np.bincount(slot, np.repeat(values, width), total.shape[1]).astype(np.int64)
        yield -1, np.array([loss])
        for i, sums in enumerate(np.split(total, len(wanted), axis=1)):
            if sums[2].any():
                yield i, sums.reshape(3, width, bins + 1)

    tasks = min(len(wanted), blocks.getNumPartitions())
    found = blocks.mapPartitions(run).reduceByKey(operator.add, tasks).collectAsMap()  # an array per wanted node
    nothing = np.zeros((3, width, bins + 1), np.int64)
    return {node: found.get(i, nothing) for i, node in enumerate(wanted)}, int(found[-1][0])


@dataclass
class Split:
    gain: float
    feature: int
    at: int
    left_rows: int


def best_split(sums: np.ndarray, settings: Settings) -> Split | None:
    """The split of a node with the largest gain; of equal ones that of the first feature and bin."""
    g, h, n = (np.cumsum(x, axis=1)[:, :-1] for x in sums)
    total_g, total_h, total_n = (x[0].sum() for x in sums)
    unit, l2 = float(UNIT), settings.l2

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a / unit) ** 2 / np.maximum(b / unit + l2, 1e-12)

    gain = score(g, h) + score(total_g - g, total_h - h) - score(total_g, total_h)
    enough = (n >= settings.min_rows) & (total_n - n >= settings.min_rows)
    gain = np.where(enough, gain, -np.inf)
    if gain.size == 0 or not (top := gain.max()) > 1e-9:
        return None
    feature, at = divmod(int(np.flatnonzero(gain == top)[0]), gain.shape[1])
    return Split(float(top), feature, at + 1, int(n[feature, at]))


def grow_tree(blocks: RDD, width: int, settings: Settings, longest: float = math.inf) -> tuple[Tree, int]:
    """The next tree, and the loss of the held-out rows before it; without splits if that loss is above ``longest``."""
    seen, sums, splits = Tree(), {}, {}
    seen.add()
    found, loss = _sums(blocks, seen, [0], width, settings.bins)
    sums |= found
    splits[0] = best_split(sums[0], settings) if loss <= longest else None
    while True:
        tree, waiting = _best_first(seen, splits, settings.leaves)
        if not waiting:
            break
        # Not only the leaf that comes next: all that may, up to as many as the tree can have.
        ready = [n for n, s in splits.items() if s is not None and seen.feature[n] < 0]
        smaller: dict[int, tuple[int, int]] = {}
        for node in sorted(ready, key=lambda n: (-splits[n].gain, n))[: settings.leaves]:
            s, rows_of = splits[node], int(sums[node][2][0].sum())
            seen.left[node], seen.right[node] = seen.add(), seen.add()
            seen.feature[node], seen.at[node] = s.feature, s.at
            few, many = (seen.left[node], seen.right[node]) if 2 * s.left_rows <= rows_of else (seen.right[node], seen.left[node])
            smaller[few] = (node, many)
        found, _ = _sums(blocks, seen, sorted(smaller), width, settings.bins)
        for few, (node, many) in smaller.items():
            sums[few], sums[many] = found[few], sums[node] - found[few]
            del sums[node]
            splits[few], splits[many] = best_split(sums[few], settings), best_split(sums[many], settings)
            for child in (few, many):
                g, h, _ = (x[0].sum() / UNIT for x in sums[child])
                seen.value[child] = float(-settings.learning_rate * g / max(h + settings.l2, 1e-12))
    return tree, loss


def _best_first(seen: Tree, splits: dict[int, Split | None], leaves: int) -> tuple[Tree, bool]:
    """The tree that splits the leaf of the largest gain next, of what is known; whether it has to wait for a leaf."""
    tree, names = Tree(), {}
    names[tree.add()] = 0
    open_ = {0: 0}  # node of the tree: node of what has been seen
    while len(open_) < leaves:
        known = [(-splits[n].gain, n, t) for t, n in open_.items() if splits[n] is not None]
        if not known:
            break
        _, node, at = min(known)
        if seen.feature[node] < 0:
            return tree, True
        del open_[at]
        tree.feature[at], tree.at[at] = seen.feature[node], seen.at[node]
        tree.left[at], tree.right[at] = tree.add(), tree.add()
        for child, old in ((tree.left[at], seen.left[node]), (tree.right[at], seen.right[node])):
            open_[child], tree.value[child] = old, seen.value[old]
    return tree, False


def fit(df: DataFrame, features: Sequence[str], held: Column, settings: Settings = Settings(), *, label: str = "label") -> Model:
    """A model of the rows for which ``held`` is false; it stops when the loss of the others no longer falls.

    Both classes weigh the same in total. Without held rows all rounds are done.
    """
    df = df.where(F.col(label).isNotNull())
    held = F.coalesce(held, F.lit(False))
    n, p, kept = df.agg(F.count_if(~held), F.count_if(~held & (F.col(label) == 1)), F.count_if(held)).first()
    if not n:
        raise ValueError("no rows to fit")
    cuts = bin_cuts(df.where(~held), features, settings.bins)
    weight = F.when(F.col(label) == 1, n / (2.0 * max(p, 1))).otherwise(n / (2.0 * max(n - p, 1)))
    width = len(features)
    blocks = _read(materialize(binned_blocks(df, features, cuts, F.col(label), weight, held), "boosting-rows"))
    trees: list[Tree] = []
    best, best_at = math.inf, 0
    try:
        for _ in range(settings.rounds):
            tree, loss = grow_tree(blocks, width, settings)
            if kept:
                if loss < best - TOLERANCE * UNIT * kept:
                    best, best_at = loss, len(trees)
                elif len(trees) - best_at >= settings.patience:
                    return Model(tuple(features), cuts, 0.0, trees[:best_at])
            if len(tree.feature) == 1:
                break
            trees.append(tree)
            before, blocks = blocks, _with_raw(blocks, tree, width)
            if len(trees) % STORE == 0:
                updated = df.sparkSession.createDataFrame(blocks, BLOCK)
                stored, computed = materialize(updated, "boosting-rows"), blocks
                blocks = _read(stored)
                computed.unpersist()
            else:
                blocks.count()
            before.unpersist()
        if kept:
            loss = grow_tree(blocks, width, settings, longest=-1)[1]
            trees = trees if loss < best - TOLERANCE * UNIT * kept else trees[:best_at]
        return Model(tuple(features), cuts, 0.0, trees)
    finally:
        blocks.unpersist()


def _with_raw(blocks: RDD, tree: Tree, width: int) -> RDD:
    def run(block: Block) -> Block:
        matrix, *_, raw = _arrays(block, width)
        return *block[:4], (raw + tree.raw(matrix)).tobytes()

    return blocks.map(run).persist(StorageLevel.MEMORY_AND_DISK)


def score_rows(model: Model, df: DataFrame, score: str = "score") -> DataFrame:
    """Add the probability of an incident."""
    df = df.drop(score)
    wide = df.select("*", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(model.features)])
    # A few hundred small trees, as text: a broadcast object needs its class on the executors.
    shared = df.sparkSession.sparkContext.broadcast(model.to_json())
    kept, names = len(df.columns), [*df.columns, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.from_json(shared.value)
        for b in batches:
            matrix = _binned(b.columns[kept:], known.cuts)
            raw = known.base + sum((t.raw(matrix) for t in known.trees), np.zeros(len(matrix)))
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(1 / (1 + np.exp(-raw)))], names)

    return wide.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())]))
