"""Full-depth regression forests and their out-of-bag importances.

Inputs are cut into at most 256 bins once, so a row travels as a byte an input, its label and a hash. A tree's bootstrap
weights are drawn from that hash and the tree's number: no sample is stored, and which rows a tree has not seen is
known wherever the row turns up again. Trees are grown to the end in batches, each batch a task with its sample;
scoring and importances bring chunks of rows together with batches of trees, so neither the rows nor the forest
are ever in one place. For scoring chunks are large, since a deep tree takes more bytes than its rows' inputs. A tree learns from
all rows it draws: above ``TASK_ROWS`` rows the upper levels of all trees are grown where the rows are
(:mod:`gustlab.operators.levels`), and only the rows below a node small enough go to one task, which grows a piece of the tree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.functions.columns import all_present, qcol
from gustlab.session import cut_lineage

BINS = 256
CHUNK_ROWS = 200_000
TASK_ROWS = 3_000_000
PIECE_ROWS = 131_072
STEP_ROWS = 8192
SCORE_ROWS = 8_000_000
SCORE_TREES = 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salted(h: np.ndarray, *salt: int) -> np.ndarray:
    for s in salt:
        with np.errstate(over="ignore"):
            h = _mix(np.asarray(h, np.uint64) + _GOLD * np.uint64(s + 1))
    return h


def weights(h: np.ndarray, tree: int, seed: int, rate: float = 1.0) -> np.ndarray:
    """How often each row is in a tree's sample: Poisson counts of mean ``rate`` fixed by the row's hash; 0 is out of bag."""
    u = (_salted(h, seed, tree) >> np.uint64(11)).astype(float) / float(1 << 53)
    steps, p, total = [], math.exp(-rate), 0.0
    for k in range(1, 40):
        total += p
        steps.append(total)
        p *= rate / k
    out = np.zeros(len(u), np.int64)
    for s in steps:
        above = u >= s
        if not above.any():
            break
        out += above
    return out


# ------------------------------------------------------------------------------------------- a tree
@dataclass
class Tree:
    """``feature`` is -1 at a leaf; a row goes to ``left`` where its bin is at most ``split``, else to ``left + 1``."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def _packed(self) -> np.ndarray:
        """A node a number: where its left child is, its split and its input. A leaf is its own child, and no bin is above 255."""
        inner = self.feature >= 0
        left = np.where(inner, self.left, np.arange(len(self.left))).astype(np.int64)
        return left << 24 | np.where(inner, self.split, 255).astype(np.int64) << 16 | np.where(inner, self.feature, 0).astype(np.int64)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each binned row, taken a few thousand rows at a time, which stay in the cache."""
        nodes, flat, k = self._packed(), np.ascontiguousarray(x).reshape(-1), x.shape[1]
        out = np.zeros(len(x), np.int64)
        for i in range(0, len(x), STEP_ROWS):
            n = min(STEP_ROWS, len(x) - i)
            at, place, live = np.zeros(n, np.int64), np.arange(i * k, (i + n) * k, k), None
            while len(at):
                node = nodes[at]
                go = node >> 24
                go += flat[place + (node & 65_535)] > (node >> 16 & 255)
                moved = go != at
                few = np.count_nonzero(moved)
                if few > 0.7 * len(at):
                    at = go
                    continue
                out[slice(i, i + n) if live is None else live] = go  # rows at a leaf are left behind
                live = np.flatnonzero(moved) + i if live is None else live[moved]
                at, place = go[moved], place[moved]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Values of binned rows."""
        return self.value[self.leaves(x)]


def _best_few(key, b, w, wy, total, sums, m, width):
    """Per node the best split of one input of ``width`` bins from a histogram of all nodes' bins: (score, bin). ``key`` is a row's
    node times ``width``, rows of node ``m`` take no part."""
    key = key + b
    wl = np.bincount(key, w, (m + 1) * width)[:m * width].reshape(m, width).cumsum(axis=1)
    sl = np.bincount(key, wy, (m + 1) * width)[:m * width].reshape(m, width).cumsum(axis=1)
    wr, sr = total[:, None] - wl, sums[:, None] - sl
    none = (wl <= 0.5) | (wr <= 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        sl *= sl
        sl /= wl
        sr *= sr
        sr /= wr
    sl += sr
    sl[none] = -np.inf
    best = sl.argmax(axis=1)
    return sl[np.arange(m), best], best


def _best_many(key, b, w, wy, total, sums, m, width):
    """The same where nodes are many and small, from the rows in the order of (node, bin)."""
    r = np.flatnonzero(key < m * width)
    r = r[np.argsort(b[r], kind="stable")]  # bytes, then pairs of bytes: these are dealt, not compared
    node = key[r] // width
    node = node.astype(np.uint16) if m < 1 << 16 else node
    order = np.argsort(node, kind="stable")
    r, node = r[order], node[order]
    b, cw, cs = b[r], np.cumsum(w[r]), np.cumsum(wy[r])
    at = np.flatnonzero((b[1:] != b[:-1]) & (node[1:] == node[:-1]))
    score, split = np.full(m, -np.inf), np.zeros(m, np.int64)
    if not len(at):
        return score, split
    k = node[at].astype(np.int64)
    first = np.cumsum(np.bincount(node, minlength=m)) - 1  # a node's sums start from those of the rows before it, with their rounding
    before_w, before_s = np.append(0.0, cw[first[:-1]]), np.append(0.0, cs[first[:-1]])
    wl, sl = cw[at] - before_w[k], cs[at] - before_s[k]
    wr, sr = total[k] - wl, sums[k] - sl
    got = sl * sl / wl + sr * sr / wr
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    top = np.maximum.reduceat(got, starts)
    hit = np.flatnonzero(got == np.repeat(top, np.diff(np.append(starts, len(k)))))
    first = hit[np.append(True, k[hit][1:] != k[hit][:-1])]
    score[k[first]], split[k[first]] = got[first], b[at[first]]
    return score, split


def _pieces(x, w, wy, node, ways, ids):
    """The rows of a level's nodes, cut between nodes into pieces of at most ``PIECE_ROWS`` rows (or one node); rows of no node are
    left out, the others keep their order inside a node."""
    m = len(ways)
    order = np.argsort(node.astype(np.uint16 if m < 1 << 16 else np.int64), kind="stable")
    ends = np.cumsum(np.bincount(node, minlength=m + 1)[:m])
    first = 0
    while first < m:
        lo = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, lo + PIECE_ROWS, side="right")))
        r = order[lo:int(ends[last - 1])]
        yield np.stack([c[r] for c in x]), w[r], wy[r], node[r] - first, ways[first:last], ids[first:last]
        first = last


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, mtry: int, node_size: int, seed: int, tree: int, roots=None) -> Tree:
    """A tree of binned rows with weights, level by level until no node above ``node_size`` rows can be split.

    Each node tries ``mtry`` inputs, chosen by a hash of the tree and the way to the node; the split that lowers the
    squared error most is taken, the first input and bin of equals. Nodes go on in pieces whose rows stay in the
    processor's cache through all their levels; rows of finished nodes are dropped once they are many. ``roots`` (each row's
    root, the ways to the roots and a number near the labels) grows what lies below several nodes: nodes 0, 1, .. of the result.
    """
    n_inputs = x.shape[1]
    w, y = w.astype(float), y.astype(float)
    # sums of squares of centred labels lose no digits
    shift = roots[2] if roots else float(np.average(y, weights=w)) if len(y) else 0.0
    x = np.ascontiguousarray(x.T)  # a line an input
    widths = [int(c.max()) + 1 if len(c) else 1 for c in x]
    node, ways = roots[:2] if roots else (np.zeros(len(y), np.int64), _salted(np.zeros(1, np.uint64), seed, tree, 7))
    made, done = len(ways), []
    todo = [(x, w, w * (y - shift), node, ways, np.arange(made))]
    while todo:
        x, w, wy, node, ways, ids = todo.pop()
        line = np.arange(len(w))
        while len(ways):
            m = len(ways)  # rows of finished nodes are at node m
            total, sums = np.bincount(node, w, m + 1)[:m], np.bincount(node, wy, m + 1)[:m]
            with np.errstate(invalid="ignore"):
                mean = np.where(total > 0, sums / total, 0.0)
            best_f, best_b = np.zeros(m, np.int64), np.zeros(m, np.int64)
            full = np.flatnonzero(total > node_size)  # only these are searched
            draw = np.stack([_salted(ways[full], f) for f in range(n_inputs)], axis=1)
            may = draw.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < mtry
            base = sums[full] * mean[full]
            score, found = base + 1e-9 * (np.abs(base) + 1e-12), np.zeros(m, bool)
            for f in range(n_inputs):
                some = np.flatnonzero(may[:, f])
                if not len(some):
                    continue
                n, at = len(some), full[some]
                start = np.full(m + 1, n * widths[f])
                start[at] = np.arange(n) * widths[f]
                find = _best_few if n * widths[f] <= 2 * len(node) + 1024 else _best_many
                s, b = find(start[node], x[f], w, wy, total[at], sums[at], n, widths[f])
                better = s > score[some] + 1e-10 * np.abs(score[some])  # a tie goes to the first input
                at = at[better]
                score[some[better]], best_f[at], best_b[at], found[at] = s[better], f, b[better], True
            n = int(found.sum())
            child = np.full(m + 1, 2 * n)
            child[:m][found] = np.arange(0, 2 * n, 2)
            done.append((ids, np.where(found, best_f, -1), best_b, np.where(found, made + child[:m], 0), mean + shift))
            go = x.reshape(-1)[np.append(best_f * len(w), 0)[node] + line] > np.append(np.where(found, best_b, 255), 255)[node]
            node = child[node]
            node += go
            ids = np.arange(made, made + 2 * n)
            made += 2 * n
            with np.errstate(over="ignore"):
                ways = _mix(np.repeat(ways[found], 2) + np.tile(np.array([1, 2], np.uint64), n))
            if not n:
                break
            if len(node) > PIECE_ROWS:
                todo += _pieces(x, w, wy, node, ways, ids)
                break
            on = node < 2 * n
            if np.count_nonzero(on) < 0.8 * len(on):
                r = np.flatnonzero(on)
                x, w, wy, node, line = np.stack([c[r] for c in x]), w[r], wy[r], node[r], line[:len(r)]
    at, feature, split, left, value = (np.concatenate(c) for c in zip(*done))
    order = np.argsort(at)
    return Tree(feature[order].astype(np.int16), split[order].astype(np.uint8), left[order].astype(np.int32), value[order])


def permuted_errors(t: Tree, x: np.ndarray, y: np.ndarray, h: np.ndarray, tree: int, seed: int) -> list[float]:
    """Squared errors of rows a tree has not seen: as they are, then with one input after the other in an order drawn from
    the rows' hashes."""
    out = [float(((t.predict(x) - y) ** 2).sum())]
    used = set(np.unique(t.feature).tolist())
    for f in range(x.shape[1]):
        if f not in used:
            out.append(out[0])
            continue
        other = x.copy()
        other[:, f] = x[np.lexsort((h, _salted(h, seed, tree, 1000 + f))), f]
        out.append(float(((t.predict(other) - y) ** 2).sum()))
    return out


# ------------------------------------------------------------------------------------------- jobs
def bin_edges(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """The upper edge of each bin of each input: all values where there are at most ``BINS``, else quantiles. A value's bin is the
    first whose edge is not below it, the last for values above all."""
    num = [qcol(c).cast("double") for c in features]
    few = df.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(num)]).first()  # a line
    few = [(few[i] or 0) <= 2 * BINS for i in range(len(num))]
    probs = [k / BINS for k in range(1, BINS + 1)]
    got = df.agg(*[(F.array_sort(F.collect_set(c)) if s else F.percentile_approx(c, probs, 100_000)).alias(f"e{i}")
                   for i, (c, s) in enumerate(zip(num, few))]).first()
    out = []
    for i in range(len(num)):
        e = np.unique(np.array(got[i] or [0.0], float))
        if len(e) > BINS:  # more values than bins, after all: every so many of them
            e = np.unique(e[np.ceil(np.arange(1, BINS + 1) * len(e) / BINS).astype(int) - 1])
        out.append(e)
    return out


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.minimum(np.searchsorted(e, values[:, i]), len(e) - 1) for i, e in enumerate(edges)]).astype(np.uint8)


_BLOCK = "chunk int, n int, x binary, y binary, h binary"


def _blocks(rows: DataFrame, edges: list[np.ndarray], count: int, chunk_rows: int) -> DataFrame:
    """Packed rows (``h``, inputs ``f*``, ``y``), dealt to chunks by their hash; written down, so chunks stay what they are."""
    k = len(edges)
    chunks = max(1, -(-count // chunk_rows))

    def pack(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                v = np.column_stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(k)])
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([chunk], pa.int32()), "n": pa.array([b.num_rows], pa.int32()), "x": [binned(v, edges).tobytes()],
                    "y": [b.column(1).to_numpy(zero_copy_only=False).astype(float).tobytes()],
                    "h": [b.column(0).to_numpy(zero_copy_only=False).tobytes()]})

    return cut_lineage(rows.select("h", "y", *[f"f{i}" for i in range(k)]).repartition(chunks, "h").mapInArrow(pack, _BLOCK))


def _unpack(t: pa.Table, k: int, more: Sequence[str] = ()):
    """Inputs, labels and hashes of a table of blocks (and columns of 4-byte numbers), rows by hash (then label), so that no order of
    arrival matters."""
    col = lambda c, dt: np.concatenate([np.frombuffer(v, dt) for v in t.column(c).to_pylist()] or [np.zeros(0, dt)])
    x, y, h = col("x", np.uint8).reshape(-1, k), col("y", float), col("h", np.int64).view(np.uint64)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(h) else np.zeros(0, np.int64)
    if len(tied):
        some = order[tied]
        order[tied] = some[np.lexsort((*x[some].T[::-1], y[some], h[some]))]
    return x[order], y[order], h[order], *[col(c, np.int32)[order] for c in more]


_TREE = "batch int, tree int, piece int, feature binary, split binary, left binary, value binary"


def _tree(t: pa.Table, i: int) -> Tree:
    """The tree of row ``i``, read where it lies."""
    col = lambda c, dt: np.frombuffer(t.column(c)[i].as_buffer(), dt)
    return Tree(col("feature", np.int16), col("split", np.uint8), col("left", np.int32), col("value", float))


def _record(batch: int, tree: int, piece: int, t: Tree) -> tuple:
    return batch, tree, piece, t.feature.tobytes(), t.split.tobytes(), t.left.tobytes(), t.value.tobytes()


def _table(records: list[tuple]) -> pa.Table:
    cols = list(zip(*records)) if records else [[]] * 7
    types = [*[pa.int32()] * 3, *[pa.binary()] * 4]
    return pa.Table.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], names=["batch", "tree", "piece", "feature", "split", "left", "value"])


class Pieces:
    """A tree in pieces: a row's value is in one of them, 0 in the others."""

    def __init__(self, trees: list[Tree]):
        self.trees, self.feature = trees, np.concatenate([t.feature for t in trees])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(t.predict(x) for t in self.trees)


def _trees(t: pa.Table) -> list[tuple[int, Tree | Pieces]]:
    number, piece, found = t.column("tree").to_pylist(), t.column("piece").to_pylist(), {}
    for i in sorted(range(len(number)), key=lambda i: (number[i], piece[i])):
        found.setdefault(number[i], []).append(_tree(t, i))
    return [(n, p[0] if len(p) == 1 else Pieces(p)) for n, p in found.items()]


@dataclass
class Forest:
    """A fitted forest: its trees as a table (checkpointed), and what scoring needs to know."""

    trees: DataFrame
    inputs: list[str]
    edges: list[np.ndarray]
    num_trees: int
    rate: float
    seed: int
    keys: list[str]
    label: str

    def _meet(self, blocks: DataFrame, chunks: int, f, schema: str) -> DataFrame:
        """``f(chunk, batch, trees, blocks)`` for every chunk of rows and batch of trees."""
        sent = self.trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        batches = self.trees.select("batch").distinct().agg(F.max("batch")).first()[0]
        dealt = blocks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches))))

        def run(key, rows, trees):
            return f(key[0].as_py(), _trees(trees), rows)

        return dealt.groupBy("chunk", "batch").cogroup(sent.groupBy("chunk", "batch")).applyInArrow(run, schema)

    def predict(self, df: DataFrame, out: str = "prediction", chunk_rows: int = SCORE_ROWS) -> DataFrame:
        """``df`` plus the mean of the trees' values; NULL where an input is NULL. Repeated rows keep a row each.

        A row travels to the trees as a byte an input, in chunks of millions of rows, since a deep tree is larger than many
        rows; sums of ``SCORE_TREES`` trees come back a block of rows. Of trees in pieces a piece meets the rows at a time, and only the
        values of the rows it has come back."""
        k, total = len(self.inputs), self.num_trees
        base = cut_lineage(df.withColumn("__r", F.monotonically_increasing_id()))
        whole = base.where(all_present(self.inputs)).select(
            F.col("__r").alias("h"), F.lit(0.0).alias("y"), *[qcol(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.inputs)])
        count = whole.count()
        chunks = max(1, -(-count // chunk_rows))
        blocks = cut_lineage(_blocks(whole, self.edges, count, CHUNK_ROWS).select(
            F.monotonically_increasing_id().alias("block"), "x", "h").withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")))
        pieces = (self.trees.agg(F.max("piece")).first()[0] or 0) + 1
        number = F.floor(F.col("tree") / SCORE_TREES) if pieces == 1 else F.col("tree") * pieces + F.col("piece")
        trees = self.trees.withColumn("batch", number.cast("int"))
        last = trees.agg(F.max("batch")).first()[0]  # NULL without trees: no row meets any
        batches = F.sequence(F.lit(0), F.lit(last).cast("int"))
        rows = blocks.select("chunk", "block", "x", F.explode(batches).alias("batch"))
        sent = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def sums(rows, trees):
            ids, xs = rows.column("block"), [np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, k) for v in rows.column("x")]
            if not xs:
                return pa.table({"block": pa.array([], pa.int64()), "at": pa.array([], pa.binary()), "s": pa.array([], pa.binary())})
            x = np.concatenate(xs)
            s = np.zeros(len(x))
            for i in np.argsort(trees.column("tree").to_numpy()):
                s += _tree(trees, int(i)).predict(x)
            parts = np.split(s, np.cumsum([len(v) for v in xs])[:-1])
            at = [np.flatnonzero(v).astype(np.uint32) if pieces > 1 else np.zeros(0, np.uint32) for v in parts]
            parts = [v[a] for v, a in zip(parts, at)] if pieces > 1 else parts
            return pa.table({"block": ids.cast(pa.int64()), "at": pa.array([a.tobytes() for a in at], pa.binary()),
                             "s": pa.array([v.tobytes() for v in parts], pa.binary())})

        def mean(rows, got):
            if not got.num_rows:
                return pa.table({"h": pa.array([], pa.int64()), "p": pa.array([], pa.float64())})
            h = np.frombuffer(rows.column("h")[0].as_buffer(), np.int64)
            s = np.zeros(len(h))
            for i in np.argsort(got.column("batch").to_numpy()):
                v = np.frombuffer(got.column("s")[int(i)].as_buffer())
                if pieces == 1:
                    s += v
                else:
                    s[np.frombuffer(got.column("at")[int(i)].as_buffer(), np.uint32)] += v
            return pa.table({"h": pa.array(h), "p": pa.array(s / total)})

        def met(key, rows, trees):
            t = sums(rows, trees)
            return t.append_column("batch", pa.array([key[1].as_py()] * t.num_rows, pa.int32()))

        got = rows.groupBy("chunk", "batch").cogroup(sent.groupBy("chunk", "batch")).applyInArrow(met, "block long, at binary, s binary, batch int")
        got = blocks.select("block", "h").groupBy("block").cogroup(got.groupBy("block")).applyInArrow(mean, "h long, p double")
        return base.join(got.withColumnRenamed("h", "__r").withColumnRenamed("p", out), "__r", "left").drop("__r")

    def out_of_bag(self, df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        """A row a tree: ``tree``, ``n`` rows of the training table ``df`` that the tree has not seen, ``sse`` their squared
        error, ``permuted`` array<double> the same with one input after the other permuted (within chunks, which hold
        rows at random)."""
        k, rate, seed = len(self.inputs), self.rate, self.seed
        rows, count = _rows(df, self.inputs, self.label, self.keys)
        blocks = _blocks(rows, self.edges, count, chunk_rows)

        def errors(chunk, trees, rows):
            x, y, h = _unpack(rows, k)
            out = []
            for i, t in trees:
                oob = weights(h, i, seed, rate) == 0
                out.append((i, int(oob.sum()), permuted_errors(t, x[oob], y[oob], h[oob], i, seed)))
            return pa.table({"tree": pa.array([o[0] for o in out], pa.int32()), "n": pa.array([o[1] for o in out], pa.int64()),
                             "e": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

        got = self._meet(blocks, max(1, -(-count // chunk_rows)), errors, "tree int, n long, e array<double>")
        e = [F.sum(F.element_at("e", i + 1)) for i in range(k + 1)]
        return got.groupBy("tree").agg(F.sum("n").alias("n"), e[0].alias("sse"), F.array(*e[1:]).alias("permuted"))

    def importance(self, df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        """``feature``, ``importance`` (mean over trees of the rise of the out-of-bag mean squared error when the input is
        permuted), ``scaled`` (that over its standard error; 0 where all trees agree), ``trees`` with out-of-bag rows."""
        one = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in self.inputs]).alias("feature"), F.col("permuted").alias("e"))).alias("z")
        per = self.out_of_bag(df, chunk_rows).where("n > 0").select("n", "sse", one).select(
            F.col("z.feature").alias("feature"), ((F.col("z.e") - F.col("sse")) / F.col("n")).alias("rise"))
        se = F.stddev_samp("rise") / F.sqrt(F.count(F.lit(1)))
        return per.groupBy("feature").agg(F.avg("rise").alias("importance"),
                                          F.coalesce(F.try_divide(F.avg("rise"), se), F.lit(0.0)).alias("scaled"),
                                          F.count(F.lit(1)).alias("trees"))


def _rows(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str]) -> tuple[DataFrame, int]:
    whole = df.where(all_present([*features, label]))
    rows = whole.select(F.xxhash64(*[qcol(c) for c in keys]).alias("h"), qcol(label).cast("double").alias("y"),
                        *[qcol(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    return rows, rows.count()


def _spread(spark, n: int) -> list[int]:
    """A number for each of ``n`` partitions that Spark's hash sends there."""
    got, size = {}, 30 * n
    while len(got) < n:
        found = spark.range(size).select(F.col("id").cast("int").alias("i"))
        got = {r[0]: r[1] for r in found.groupBy(F.pmod(F.hash("i"), F.lit(n))).agg(F.min("i")).collect()}  # a line a partition
        size *= 4
    return [got[i] for i in range(n)]


def _in_pieces(blocks: DataFrame, k: int, num_trees: int, mtry: int, node_size: int, seed: int, task_rows: int) -> DataFrame:
    """Trees of more rows than a task should hold. Upper levels are grown by passes over the blocks until every open node has few
    rows; nodes are put together to pieces of at most about ``task_rows`` rows, and a task grows what lies below a piece's nodes."""
    from gustlab.operators import levels

    spark = blocks.sparkSession
    tasks = levels.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    few = blocks.coalesce(tasks)

    def read(r):
        x = np.frombuffer(r["x"], np.uint8).reshape(-1, k)
        return np.ascontiguousarray(x.T), np.frombuffer(r["y"]), None, np.frombuffer(r["h"], np.int64).view(np.uint64)

    def middle(batches):
        for b in batches:
            for y in b.column("y").to_pylist():
                yield pa.RecordBatch.from_pydict({"s": [float(np.frombuffer(y).sum())], "n": [len(y) // 8]})

    r = few.select("y").mapInArrow(middle, "s double, n long").agg(F.sum("s") / F.sum("n")).first()
    shift, enough = float(r[0]), max(1.0, 0.6 * task_rows)
    growing = [levels.Growing(t, seed, mtry, list(range(k)), node_size=node_size, enough=enough) for t in range(num_trees)]
    while any(len(g.open) for g in growing):
        levels.grow_level(few, growing, read, lambda h, seed, tree: weights(h, tree, seed), BINS, shift)
    growing = [g for g in growing if g.weight[0] > 0]
    pieces, tops, done = [], [], []  # (tree's place, piece, its nodes, ways to them)
    for i, g in enumerate(growing):
        piece, local = np.full(len(g.feature), -1), np.zeros(len(g.feature), np.int32)
        held, first = np.inf, len(pieces)
        for node, way in g.aside:
            if held + g.weight[node] > enough:
                pieces.append((i, len(pieces) - first, [], []))
                held = 0.0
            held += g.weight[node]
            piece[node], local[node] = len(pieces) - 1, len(pieces[-1][2])
            pieces[-1][2].append(node)
            pieces[-1][3].append(way)
        tops.append((g.tree, *g.nodes()[:3], g.level, piece, local))
        if not g.aside:
            done.append(_record(g.tree, g.tree, 0, g.whole()))

    def send(batches):
        for b in batches:
            for r in b.to_pylist():
                x, y, _, h = read(r)
                for tree, feature, split, left, steps, piece, local in tops:
                    on = np.flatnonzero(weights(h, tree, seed))
                    at = levels.at_nodes(x.take(on, axis=1), feature, split, left, steps)
                    to = piece[at]
                    parts = [(q, on[to == q], at[to == q]) for q in np.unique(to) if q >= 0]
                    yield pa.RecordBatch.from_pydict({
                        "p": pa.array([q for q, _, _ in parts], pa.int32()), "x": pa.array([x[:, o].T.tobytes() for _, o, _ in parts], pa.binary()),
                        "y": pa.array([y[o].tobytes() for _, o, _ in parts], pa.binary()), "h": pa.array([h[o].tobytes() for _, o, _ in parts], pa.binary()),
                        "node": pa.array([local[a].tobytes() for _, _, a in parts], pa.binary())})

    def learn(key, t):
        i, number, nodes, ways = pieces[key[0].as_py()]
        g, m = growing[i], len(nodes)
        x, y, h, node = _unpack(t, k, ["node"])
        below = grow(x, y, weights(h, g.tree, seed), mtry, node_size, seed, g.tree, (node.astype(np.int64), np.array(ways, np.uint64), shift))
        top = g.whole()
        value = np.zeros(len(top.value))
        if not number:  # leaves of the upper levels count once
            leaf = top.feature < 0
            leaf[[n for n, _ in g.aside]] = False
            value[leaf] = top.value[leaf]
        left = np.where(below.feature >= 0, below.left + (len(value) - m), 0).astype(np.int32)
        cols = []
        for upper, lower in ((top.feature, below.feature), (top.split, below.split), (top.left, left), (value, below.value)):
            c = np.concatenate([upper, lower[m:]])
            c[nodes] = lower[:m]
            cols.append(c)
        return _table([_record(g.tree, g.tree, number, Tree(*cols))])

    out = spark.createDataFrame(done, _TREE)
    if pieces:
        sent = few.mapInArrow(send, "p int, x binary, y binary, h binary, node binary")
        out = sent.repartition(min(len(pieces), 2000), "p").groupBy("p").applyInArrow(learn, _TREE).unionAll(out)
    return cut_lineage(out)


def fit_forest(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], num_trees: int = 500, mtry: int | None = None,
               node_size: int = 5, seed: int = 123, sample_rows: int | None = None, trees_a_batch: int = 8,
               chunk_rows: int = CHUNK_ROWS, task_rows: int = TASK_ROWS) -> Forest:
    """A regression forest of ``num_trees`` trees, grown until nodes hold ``node_size`` rows or cannot be split; ``mtry`` inputs
    a node (default: a third).

    ``keys`` name a row: rows of equal keys draw equal weights. A tree learns from a bootstrap sample of as many rows as there
    are; only where a caller gives ``sample_rows`` of about so many. Above ``task_rows`` rows trees are grown in pieces
    (:func:`_in_pieces`), so a task holds no more than about so many rows. Rows with a NULL input or label take no part; without
    rows the forest has no trees to score with and predicts NULL.
    """
    features = list(features)
    k, m = len(features), max(1, min(mtry or max(1, len(features) // 3), len(features)))
    rows, count = _rows(train, features, label, keys)
    edges = bin_edges(train.where(all_present([*features, label])), features)
    rate = min(1.0, sample_rows / max(count, 1)) if sample_rows else 1.0
    size = trees_a_batch if rate == 1.0 else 1
    batches = -(-num_trees // size)
    blocks = _blocks(rows, edges, count, chunk_rows)
    if rate == 1.0 and count > task_rows:
        trees = _in_pieces(blocks, k, num_trees, m, node_size, seed, task_rows)
        return Forest(trees, features, edges, max(trees.select("tree").distinct().count(), 1), rate, seed, list(keys), label)
    every = F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))
    if rate == 1.0:
        dealt = blocks.withColumn("batch", every)
    else:
        def sampled(got):
            for b in got:
                for r in b.to_pylist():
                    h = np.frombuffer(r["h"], np.int64)
                    x, y = np.frombuffer(r["x"], np.uint8).reshape(-1, k), np.frombuffer(r["y"])
                    for i in range(batches):
                        on = weights(h.view(np.uint64), i, seed, rate) > 0
                        if on.any():
                            yield pa.RecordBatch.from_pydict({
                                "chunk": pa.array([r["chunk"]], pa.int32()), "n": pa.array([int(on.sum())], pa.int32()),
                                "x": [x[on].tobytes()], "y": [y[on].tobytes()], "h": [h[on].tobytes()], "batch": pa.array([i], pa.int32())})

        dealt = blocks.mapInArrow(sampled, _BLOCK + ", batch int")

    def learn(key, t):
        x, y, h = _unpack(t, k)
        batch, out = place[key[0].as_py()], []
        for i in range(batch * size, min((batch + 1) * size, num_trees)):
            w = weights(h, i, seed, rate)
            on = w > 0
            if on.any():
                g = grow(x[on], y[on], w[on], m, node_size, seed, i)
                out.append(_record(batch, i, 0, g))
        return _table(out)

    deal = _spread(train.sparkSession, batches)  # a batch a partition
    place = {d: i for i, d in enumerate(deal)}
    dealt = dealt.withColumn("deal", F.element_at(F.array(*[F.lit(d) for d in deal]), F.col("batch") + 1)).drop("batch")
    trees = cut_lineage(dealt.repartition(batches, "deal").groupBy("deal").applyInArrow(learn, _TREE))
    return Forest(trees, features, edges, max(trees.count(), 1), rate, seed, list(keys), label)
