"""Regression trees grown level by level over rows that stay where they are.

Rows are written down once, a byte an input beside the label. A level is one pass for all trees of all forests: a task sums
weights and weighted labels of its rows by open node, input and bin; the sums of a tree meet in one task, which chooses the
splits; only splits reach the driver. A task holds one chunk of rows and at most ``SUM_BYTES`` of sums, whatever the table's
size. Every row takes part in every tree that draws it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import all_present, qcol
from gustlab.operators.forest import Tree, _mix, _salted, binned
from gustlab.session import cut_lineage

WIDTH = 32
CHUNK_ROWS = 100_000
SUM_BYTES = 64 << 20
TASKS_A_CORE = 2
SKETCH = 1024


# ------------------------------------------------------------------------------------------- trees on their way
@dataclass
class Growing:
    """A tree with its open nodes. ``depth`` levels at most, over the inputs ``inputs``; rows of fold ``without`` take no part.
    Nodes of at most ``node_size`` rows stay leaves; those of at most ``enough`` rows are set aside in ``aside``."""

    tree: int
    seed: int
    mtry: int
    inputs: list[int]
    depth: int = 1 << 30
    without: int = -1
    node_size: int = 1
    enough: float = 0.0
    level: int = 0
    feature: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int64))
    split: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1))
    gains: dict[int, float] = field(default_factory=dict)
    open: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    ways: np.ndarray | None = None
    aside: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.ways = _salted(np.zeros(1, np.uint64), self.seed, self.tree, 7)

    def tried(self) -> np.ndarray:
        """(inputs, open nodes): which inputs a node tries, by a hash of the tree and the way to the node."""
        draw = np.stack([_salted(self.ways, f) for f in self.inputs], axis=1)
        return (draw.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < self.mtry).T

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input, split, left child (a leaf is its own) and the place among the open nodes (their number: none) of every node."""
        inner = self.feature >= 0
        slot = np.full(len(self.feature), len(self.open))
        slot[self.open] = np.arange(len(self.open))
        return (np.where(inner, self.feature, 0), np.where(inner, self.split, 255),
                np.where(inner, self.left, np.arange(len(self.left))), slot)

    def grown(self, found, f, b, w, s, wl, sl, gain, shift: float) -> None:
        """Takes the splits of the open nodes; their children are the next open nodes."""
        if not self.level:
            self.value[0], self.weight[0] = (s[0] / w[0] if w[0] > 0 else 0.0) + shift, w[0]
        at, made, n = self.open[found], len(self.feature), int(found.sum())
        self.feature[at], self.split[at], self.left[at] = np.array(self.inputs)[f[found]], b[found], made + 2 * np.arange(n)
        for i, x in zip(f[found], gain[found]):
            self.gains[self.inputs[i]] = self.gains.get(self.inputs[i], 0.0) + float(x)
        wr, sr = w[found] - wl[found], s[found] - sl[found]
        more = lambda a, v: np.concatenate([a, v])
        self.feature, self.split, self.left = more(self.feature, np.full(2 * n, -1)), more(self.split, np.zeros(2 * n, int)), more(self.left, np.zeros(2 * n, int))
        self.weight = more(self.weight, np.stack([wl[found], wr], 1).ravel())
        self.value = more(self.value, np.stack([sl[found] / wl[found], sr / wr], 1).ravel() + shift)
        kids = np.arange(made, made + 2 * n)
        with np.errstate(over="ignore"):
            ways = _mix(np.repeat(self.ways[found], 2) + np.tile(np.array([1, 2], np.uint64), n))
        self.level += 1
        big = (self.weight[kids] > self.node_size) & (self.level < self.depth)
        small = big & (self.weight[kids] <= self.enough)
        self.aside += list(zip(kids[small].tolist(), ways[small].tolist()))
        self.open, self.ways = kids[big & ~small], ways[big & ~small]

    def whole(self, inputs: Sequence[int] | None = None) -> Tree:
        """The finished tree; its inputs by their place in ``inputs`` where these are given."""
        f = self.feature
        if inputs is not None:
            place = np.zeros(max([*inputs, 0]) + 1, np.int64)
            place[list(inputs)] = np.arange(len(inputs))
            f = np.where(f >= 0, place[f], -1)
        return Tree(f.astype(np.int16), self.split.astype(np.uint8), self.left.astype(np.int32), self.value)


def at_nodes(x: np.ndarray, feature, split, left, steps: int) -> np.ndarray:
    """The node of each row, a column of ``x``, after ``steps`` levels."""
    n, flat = x.shape[1], x.reshape(-1)
    nodes = left << 40 | split << 32 | feature * n
    at, line = np.zeros(n, np.int64), np.arange(n)
    for _ in range(steps):
        node = nodes[at]
        at = node >> 40
        at += flat[(node & 0xFFFFFFFF) + line] > (node >> 32 & 255)
    return at


def summed(x: np.ndarray, y: np.ndarray, w: np.ndarray, table, inputs: Sequence[int], may: np.ndarray, steps: int, width: int) -> np.ndarray:
    """(2, tried pairs of input and open node, ``width``): weights and weighted labels of rows (columns of ``x``) by bin."""
    r = np.flatnonzero(w)
    x = x.take(r, axis=1)
    w = w[r].astype(float)
    wy, m = w * y[r], may.shape[1]
    at = table[3][at_nodes(x, *table[:3], steps)] * width
    out = np.zeros((2, *may.shape, width))
    for j, f in enumerate(inputs):
        if may[j].any():
            key = at + x[f]
            for i, v in enumerate((w, wy)):
                out[i, j] = np.bincount(key, v, (m + 1) * width)[:m * width].reshape(m, width)
    return out[:, may]


def chosen(got: np.ndarray, may: np.ndarray, node_size: int):
    """Per open node of ``may`` the best split from its sums ``got``: found, input (its place), bin, weight, sum, those left of the
    split, and the fall of the squared error. The first input and bin of equals."""
    m = may.shape[1]
    total, sums = np.zeros(m), np.zeros(m)
    wl, sl = got.cumsum(axis=2)
    for i, node in enumerate(np.nonzero(may)[1]):
        total[node], sums[node] = wl[i, -1], sl[i, -1]
    base = np.divide(sums * sums, total, out=np.zeros(m), where=total > 0)
    score, found = base + 1e-9 * (np.abs(base) + 1e-12), np.zeros(m, bool)
    best_f, best_b, left_w, left_s = np.zeros(m, int), np.zeros(m, int), np.zeros(m), np.zeros(m)
    first = 0
    for j in range(len(may)):
        node = np.flatnonzero(may[j])
        some = slice(first, first + len(node))
        first += len(node)
        w, s = wl[some], sl[some]
        wr, sr = total[node, None] - w, sums[node, None] - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((w <= 0.5) | (wr <= 0.5), -np.inf, s * s / w + sr * sr / wr)
        b = gain.argmax(axis=1)
        row = np.arange(len(node))
        better = (gain[row, b] > score[node] + 1e-10 * np.abs(score[node])) & (total[node] > node_size)
        at, row, b = node[better], row[better], b[better]
        score[at], best_f[at], best_b[at], left_w[at], left_s[at], found[at] = gain[row, b], j, b, w[row, b], s[row, b], True
    return found, best_f, best_b, total, sums, left_w, left_s, score - base


def grow_level(blocks: DataFrame, growing: Sequence[Growing], read, draw, width: int, shift: float) -> None:
    """Splits every open node of ``growing`` in one pass. ``read(record)`` gives the rows of a block as (inputs by line, labels,
    folds or None, whatever ``draw`` needs); ``draw(that, seed, tree)`` their weights in a tree."""
    jobs, size = [[]], 0
    for i, g in enumerate(growing):
        if len(g.open):
            b = 16 * len(g.inputs) * len(g.open) * width
            if jobs[-1] and size + b > SUM_BYTES:
                jobs.append([])
                size = 0
            jobs[-1].append(i)
            size += b
    if not jobs[0]:
        return
    plan = {i: (g.nodes(), g.inputs, g.tried(), g.level, g.seed, g.tree, g.without, g.node_size)
            for i, g in enumerate(growing) if len(g.open)}

    def sums(trees):
        mine = sorted(((i, plan[i]) for i in trees), key=lambda p: p[1][4:6])  # equal draws after one another

        def run(batches):
            from pyspark import TaskContext

            acc: dict[int, np.ndarray] = {}
            for batch in batches:
                for record in batch.to_pylist():
                    x, y, fold, ids = read(record)
                    y = y - shift
                    last, drawn = None, None
                    for i, (table, inputs, may, level, seed, tree, without, _) in mine:
                        if last != (seed, tree):
                            last, drawn = (seed, tree), draw(ids, seed, tree)
                        w = drawn if without < 0 else np.where(fold == without, 0, drawn)
                        s = summed(x, y, w, table, inputs, may, level, width)
                        if i in acc:
                            acc[i] += s
                        else:
                            acc[i] = s
            part = TaskContext.get().partitionId()
            for i, s in acc.items():
                yield pa.RecordBatch.from_pydict({"t": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "s": [s.tobytes()]})
        return run

    asked = {i: (p[2], p[7]) for i, p in plan.items()}

    def choose(key, t):
        i = key[0].as_py()
        may, node_size = asked[i]
        got = np.zeros((2, int(may.sum()), width))
        for j in np.argsort(t.column("part").to_numpy()):  # in one order, so sums do not depend on arrival
            got += np.frombuffer(t.column("s")[int(j)].as_buffer()).reshape(got.shape)
        out = np.stack([np.asarray(c, float) for c in chosen(got, may, node_size)])
        return pa.table({"t": pa.array([i], pa.int32()), "out": pa.array([out.tobytes()], pa.binary())})

    parts = reduce(DataFrame.unionAll, [blocks.mapInArrow(sums(j), "t int, part int, s binary") for j in jobs])
    for r in parts.groupBy("t").applyInArrow(choose, "t int, out binary").collect():  # the splits of a level
        found, f, b, *rest = np.frombuffer(r["out"]).reshape(8, -1)
        growing[r["t"]].grown(found > 0, f.astype(int), b.astype(int), *rest, shift)
        del plan[r["t"]]
    for i in plan:  # no rows at all
        growing[i].open = growing[i].open[:0]


# ------------------------------------------------------------------------------------------- rows
_STEPS: list[int] = []
_p, _total = float(np.exp(-1.0)), 0.0
for _k in range(1, 14):
    _total += _p
    _STEPS.append(min(int(_total * 2.0 ** 32), 2 ** 32 - 1))
    _p /= _k


def poisson(n: int, *key: int) -> np.ndarray:
    """``n`` Poisson counts of mean 1, fixed by ``key``."""
    u = np.random.SFC64(np.random.SeedSequence(key)).random_raw((n + 1) // 2).view(np.uint32)[:n]
    w = np.zeros(n, np.uint8)
    for s in _STEPS:
        w += u >= np.uint32(s)
    return w


@dataclass
class Packed:
    """Rows written down for forests: blocks of binned inputs, labels and folds, and the upper edges of the bins."""

    blocks: DataFrame
    inputs: list[str]
    edges: list[np.ndarray]
    mean: float


def _points(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and their counts; of more than ``SKETCH`` values the upper ends of as many equal shares."""
    v, n = np.unique(v, return_counts=True)
    if len(v) <= SKETCH:
        return v, n.astype(float)
    c = np.cumsum(n)
    at = np.unique(np.searchsorted(c, c[-1] * np.arange(1, SKETCH + 1) / SKETCH))
    return v[at], np.diff(c[at], prepend=0).astype(float)


def _edges(v: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """All values where there are at most ``bins``, else quantiles; the last edge is the greatest value."""
    v, at = np.unique(v, return_inverse=True)
    if len(v) <= bins:
        return v if len(v) else np.zeros(1)
    c = np.cumsum(np.bincount(at, n))
    return np.unique(v[np.minimum(np.searchsorted(c, c[-1] * np.arange(1, bins + 1) / bins * (1 - 1e-12)), len(v) - 1)])


def _numbers(b: pa.RecordBatch, i: int) -> np.ndarray:
    return b.column(i).to_numpy(zero_copy_only=False)


def find_edges(rows: DataFrame, k: int, bins: int = WIDTH, chunk_rows: int = CHUNK_ROWS) -> tuple[list[np.ndarray], int, float]:
    """Upper bin edges of the columns ``f0``.. of ``rows``, the number of rows and the mean of ``y``, in one pass over all rows.

    Edges are all values where there are few, else quantiles: a part of the rows gives at most ``SKETCH`` points an input, each
    standing for an equal share of it, so a quantile's rank is off by at most a ``SKETCH``-th."""
    def sketch(batches):
        held, n = [], 0

        def points():
            y = np.concatenate([_numbers(b, 1) for b in held])
            out = [(-1, np.array([y.sum()]), np.array([float(len(y))]))]
            out += [(i, *_points(np.concatenate([_numbers(b, 2 + i) for b in held]))) for i in range(k)]
            return pa.RecordBatch.from_pydict({"f": pa.array([o[0] for o in out], pa.int32()), "v": [o[1].tobytes() for o in out],
                                               "n": [o[2].tobytes() for o in out]})
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= chunk_rows:
                yield points()
                held, n = [], 0
        if n:
            yield points()

    def merge(key, t):
        v, n = (np.concatenate([np.frombuffer(x.as_buffer()) for x in t.column(c)]) for c in ("v", "n"))
        out = np.array([v.sum(), n.sum()]) if key[0].as_py() < 0 else _edges(v, n, bins)
        return pa.table({"f": pa.array([key[0].as_py()], pa.int32()), "e": pa.array([out.tobytes()], pa.binary())})

    points = rows.mapInArrow(sketch, "f int, v binary, n binary")
    got = {r["f"]: np.frombuffer(r["e"]) for r in points.groupBy("f").applyInArrow(merge, "f int, e binary").collect()}  # a line an input
    s, n = got.get(-1, (0.0, 0.0))
    return [got.get(i, np.zeros(1)) for i in range(k)], int(n), s / n if n else 0.0


_ATOMS = ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "boolean", "date", "timestamp", "timestamp_ntz", "binary")


def pack(df: DataFrame, features: Sequence[str], label: str, fold: str | None = None, chunk_rows: int = CHUNK_ROWS) -> Packed:
    """The complete rows of ``df`` as blocks, dealt to chunks by a hash of all their columns and ordered by it, so draws do not
    depend on the order of arrival. ``fold``: an integer column, 0 to 255."""
    k = len(features)
    whole = df.where(all_present([*features, label]))
    rows = whole.select(F.xxhash64(*[qcol(c) for c, t in df.dtypes if t in _ATOMS or t.startswith("decimal")]).alias("h"),
                        qcol(label).cast("double").alias("y"), *[qcol(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)],
                        (qcol(fold).cast("int") if fold else F.lit(0)).alias("fold"))
    edges, count, mean = find_edges(rows, k, chunk_rows=chunk_rows)
    chunks = max(1, -(-count // chunk_rows))

    def write(batches):
        from pyspark import TaskContext

        held, n, block, chunk = [], 0, 0, TaskContext.get().partitionId()

        def record():
            h, y, *x, fold = (np.concatenate([_numbers(b, i) for b in held]) for i in range(k + 3))
            x = binned(np.column_stack(x), edges)
            order = np.lexsort((*x.T[::-1], y, h)) if len(np.unique(h)) < len(h) else np.argsort(h)
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk], pa.int32()), "block": pa.array([block], pa.int32()), "x": [np.ascontiguousarray(x[order].T).tobytes()],
                "y": [y[order].tobytes()], "fold": [fold[order].astype(np.uint8).tobytes()]})
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 2 * chunk_rows:  # only where many rows are equal
                yield record()
                held, n, block = [], 0, block + 1
        if n:
            yield record()

    blocks = cut_lineage(rows.repartition(chunks, "h").mapInArrow(write, "chunk int, block int, x binary, y binary, fold binary"))
    tasks = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return Packed(blocks.coalesce(tasks) if chunks > tasks else blocks, list(features), edges, mean)


# ------------------------------------------------------------------------------------------- forests
@dataclass
class LevelForest:
    """A fitted forest: trees over binned inputs, and the falls of the squared error by tree and input."""

    inputs: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    gains: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean of the trees' values of rows of raw inputs."""
        b = binned(x, self.edges)
        return sum(t.predict(b) for t in self.trees) / len(self.trees)

    def importances(self) -> np.ndarray:
        """Share of the inputs in the falls of the squared error, a tree like the other."""
        total = self.gains.sum(axis=1, keepdims=True)
        per = np.divide(self.gains, total, out=np.zeros_like(self.gains), where=total > 0).sum(axis=0)
        return per / per.sum() if per.sum() > 0 else per


def fit_level_forests(rows: Packed, wanted: Sequence[dict]) -> list[LevelForest]:
    """Forests of ``wanted`` (``num_trees``, ``mtry``, ``max_depth``, ``seed``, and maybe ``features`` and the fold ``without``), all
    grown in the same passes: a pass a level."""
    k = len(rows.inputs)
    growing, of = [], []
    for s in wanted:
        at = [rows.inputs.index(c) for c in s.get("features", rows.inputs)]
        of.append((at, range(len(growing), len(growing) + s["num_trees"])))
        growing += [Growing(t, s["seed"], min(s["mtry"], len(at)), at, s["max_depth"], s.get("without", -1)) for t in range(s["num_trees"])]

    def read(r):
        y = np.frombuffer(r["y"])
        return np.frombuffer(r["x"], np.uint8).reshape(k, -1), y, np.frombuffer(r["fold"], np.uint8), (len(y), r["chunk"], r["block"])

    def draw(ids, seed, tree):
        return poisson(ids[0], seed, tree, ids[1], ids[2])

    while any(len(g.open) and g.level < g.depth for g in growing):
        grow_level(rows.blocks, growing, read, draw, WIDTH, rows.mean)
    out = []
    for at, some in of:
        gains = np.array([[growing[i].gains.get(f, 0.0) for f in at] for i in some])
        out.append(LevelForest([rows.inputs[f] for f in at], [rows.edges[f] for f in at], [growing[i].whole(at) for i in some], gains))
    return out
