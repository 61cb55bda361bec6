"""Embedding near-duplicates over robust-pruned flat graphs.

Vectors of one label are clustered (k-means on a bounded sample), and each goes to its nearest clusters, so the shards
overlap. In each shard a flat graph is built by robust pruning: of a vector's nearest neighbours in the shard, one is
dropped where a neighbour already chosen is nearer to it by the factor ``ALPHA`` than the vector itself. The adjacency lists of
a vector from all its shards are united. Each shard is then searched from its medoid: a greedy search with a list of
``BEAM`` candidates leads to the query's neighbourhood, and from there the search expands the range: every vector found in
range has its neighbours visited, until none in range is left. Found pairs are verified by cosine in double precision. A pair
that meets in several shards counts in one of them.

Equal vectors (of a label) are one node, so a very common vector costs nothing. A shard over ``cap`` vectors is dealt to
slices, each with its own graph, and all its queries search every slice: no vector is left out.

Recall is audited: for a bounded sample of vectors the links found are compared with those of all vectors, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.llm import blocks as B
from gustlab.llm.components import components
from gustlab.llm.jaccard import Forest
from gustlab.session import cut_lineage

DEGREE, BEAM, ALPHA, NEAREST = 24, 24, 1.2, 64
SAMPLE, SHARD, OVERLAP = 20_000, 300, 3
SAMPLE_BYTES = 64 << 20
AUDIT = 500


# ---------------------------------------------------------------------------------------------- one shard, in NumPy
def robust_prune(sim: np.ndarray, order: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Pruned neighbour lists. ``order`` [n, k]: nearest others of each vector; ``sim`` the cosines among all n."""
    dist = np.sqrt(np.maximum(0, 2 - 2 * sim))
    n, k = order.shape
    alive = np.ones((n, k), bool)
    chosen = np.zeros((n, k), bool)
    count = np.zeros(n, np.int64)
    mine = np.take_along_axis(dist, order, 1)
    rows = np.arange(n)
    for c in range(k):  # the c-th nearest of all vectors at once
        take = alive[:, c] & (count < degree)
        chosen[take, c] = True
        count += take
        if c + 1 < k and take.any():
            r = rows[take]
            between = dist[order[r, c][:, None], order[r, c + 1:]]
            alive[r, c + 1:] &= alpha * between > mine[r, c + 1:]
    return [order[i, chosen[i]] for i in range(n)]


def build(x: np.ndarray) -> list[np.ndarray]:
    """Pruned neighbour lists of a shard's unit vectors, with a few random others."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(NEAREST, n - 1)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1), 1)
    # long edges keep a flat graph in one piece: some random others end the candidate list
    g = np.random.default_rng(n)
    far = g.integers(0, n - 1, (n, min(4, n - 1)))
    far += far >= np.arange(n)[:, None]
    return [np.unique(np.concatenate([a, far[i]])) for i, a in enumerate(robust_prune(sim, near))]


def both_ways(lists: list[np.ndarray]) -> list[np.ndarray]:
    """The lists with every edge also at its other end."""
    n = len(lists)
    if not n:
        return []
    src = np.repeat(np.arange(n), [len(a) for a in lists])
    dst = np.concatenate(lists)
    pair = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    return np.split(pair % n, np.searchsorted(pair // n, np.arange(1, n)))


def range_search(q: np.ndarray, x: np.ndarray, start: int, adj: list[np.ndarray], reach: float, beam: int = BEAM,
                 block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs with cosine >= ``reach`` that the search finds; queries step at once, in blocks."""
    n = len(x)
    width = max((len(a) for a in adj), default=0)
    table = np.full((n, max(width, 1)), -1, np.int64)
    for i, a in enumerate(adj):
        table[i, :len(a)] = a
    found_q, found_x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(q), block):
        Q = q[lo:lo + block]
        m = len(Q)
        sim = np.full((m, n), -np.inf, np.float32)  # of visited vectors
        open_ = np.full((m, n), -np.inf, np.float32)  # of those not expanded yet
        sim[:, start] = open_[:, start] = Q @ x[start]
        live = np.arange(m)
        while len(live):
            at = open_[live].argmax(1)
            best = open_[live, at]
            # go on while the best open one is in range or among the beam's best
            if n > beam:
                worst = np.partition(sim[live], n - beam, axis=1)[:, n - beam]
            else:
                worst = np.full(len(live), -np.inf, np.float32)
            go = np.isfinite(best) & ((best >= reach) | (best >= worst))
            live, at = live[go], at[go]
            if not len(live):
                break
            open_[live, at] = -np.inf
            nb = table[at]
            r = np.repeat(live, nb.shape[1])
            c = nb.ravel()
            ok = c >= 0
            r, c = r[ok], c[ok]
            new = np.isneginf(sim[r, c])
            r, c = r[new], c[new]
            if len(r):
                s = np.einsum("ij,ij->i", Q[r], x[c])
                sim[r, c] = s
                open_[r, c] = s
        a, b = np.nonzero(sim >= reach)
        found_q.append(a + lo)
        found_x.append(b)
    return np.concatenate(found_q), np.concatenate(found_x)


# ---------------------------------------------------------------------------------------------- clusters
def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors."""
    g = np.random.default_rng(seed)
    c = x[g.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        to = (x @ c.T).argmax(1)
        for j in range(len(c)):
            m = x[to == j]
            if len(m):
                v = m.sum(0)
                c[j] = v / max(np.linalg.norm(v), 1e-12)
    return c


def _matrix(col, dim: int | None = None) -> np.ndarray:
    return np.array(col.to_pylist(), np.float64) if len(col) else np.zeros((0, dim or 0))


def _centroids(nodes: DataFrame, sizes: list, sample: int, shard: int) -> dict:
    """Centroids by (label, dimension), from a sample of at most ``sample`` vectors and SAMPLE_BYTES over all, the first by a
    hash."""
    widest = max((r["dim"] for r in sizes), default=1)
    sample = min(sample, max(64, SAMPLE_BYTES // (8 * widest)))  # long vectors: fewer of them
    rows = nodes.orderBy(F.xxhash64("rep", F.lit(9)), "rep").limit(sample).select("label", "dim", "v").collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault((r["label"], r["dim"]), []).append(np.frombuffer(r["v"], np.float64))
    count = {(r["label"], r["dim"]): r["n"] for r in sizes}
    return {g: kmeans(np.stack(v), max(1, min(-(-count[g] // shard), len(v) // 8 + 1))).astype(np.float32) for g, v in groups.items()}


def near_duplicates(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = 0.98, sample: int = SAMPLE, shard: int = SHARD, overlap: int = OVERLAP,
                    cap: int = 2048, audit: int = AUDIT, min_recall: float = 0.95) -> DataFrame:
    """One row a distinct id: the id, ``n_links`` long, ``component_id`` long, ``kept`` boolean (id = component_id).

    The links of the ``audit`` first vectors by a hash are counted against all vectors as well; where fewer than
    ``min_recall`` of them were found, the search runs again with twice the overlap of the shards, up to all of them.

    Two vectors link where their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least ``threshold``. Null, empty and zero vectors, and such with null or non-finite components, link
    with nothing. Rows with a null id are left out; rows that share an id count as one vector for each distinct
    vector, their links add up. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    src = embeddings.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
                            F.col(vector).cast("array<double>").alias("e")).where("id is not null")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    good = src.where(usable)

    def unit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for v in b.column(2).to_pylist():
                v = np.array(v, np.float64)
                v = v / np.abs(v).max()  # against overflow of the squares
                out.append(v / np.linalg.norm(v))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(v) for v in out], pa.int32()),
                                              pa.array([v.tobytes() for v in out], pa.binary())], ["id", "label", "dim", "v"])

    units = cut_lineage(good.mapInArrow(unit, "id bigint, label string, dim int, v binary"))
    # a node: a distinct vector of a label; its representative is the smallest id
    nodes = cut_lineage(units.groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("weight"))
                        .withColumn("node", F.xxhash64("label", "dim", "v")))
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "dim").limit(sample).collect()
    centers = spark.sparkContext.broadcast(_centroids(nodes, sizes, sample, shard))

    def assign(batches):
        for b in batches:
            label_, dim = b.column(0).to_pylist(), b.column(1).to_pylist()
            lists = [[0]] * b.num_rows
            groups: dict = {}
            for i, g in enumerate(zip(label_, dim)):
                groups.setdefault(g, []).append(i)
            vs = b.column(2).to_pylist()
            for g, rows in groups.items():
                c = centers.value.get(g)
                if c is None or len(c) < 2:
                    continue  # a group outside the sample is one shard
                x = np.stack([np.frombuffer(vs[i], np.float64) for i in rows]).astype(np.float32)
                s = x @ c.T
                k = min(overlap, len(c))
                top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
                for i, t in zip(rows, top.tolist()):
                    lists[i] = sorted(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))],
                                             ["label", "dim", "v", "rep", "weight", "node", "shards"])

    placed = nodes.select("label", "dim", "v", "rep", "weight", "node").mapInArrow(
        assign, "label string, dim int, v binary, rep bigint, weight bigint, node bigint, shards array<int>")
    placed = cut_lineage(placed)
    member = placed.withColumn("shard", F.explode("shards"))
    load = member.groupBy("label", "dim", "shard").agg(F.count("*").alias("n"))
    load = load.withColumn("slices", F.ceil(F.col("n") / F.lit(cap)).cast("int")).drop("n")
    member = (member.join(load, ["label", "dim", "shard"])
              .withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int")))
    member = cut_lineage(member.withColumn("key", F.xxhash64("label", "dim", "shard")))

    def graph(batches):
        for t in B.grouped(batches, 2):
            x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(t.num_rows, -1).astype(np.float32)
            node = t.column("node").to_numpy()
            lists = [node[a].tobytes() for a in build(x)]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(lists, pa.binary())], ["node", "out"])

    lists = (member.select("key", "slice", "node", "v").repartition("key", "slice").sortWithinPartitions("key", "slice", "node")
             .mapInArrow(graph, "node bigint, out binary"))
    # the union of a vector's lists, one of each of its shards
    union = lists.groupBy("node").agg(F.collect_list("out").alias("lists"))
    # a shard's vectors go to their slice as targets, and to every slice as queries
    targets = member.join(union, "node").select("key", "slice", F.lit(0).alias("role"), "node", "rep", "weight", "v", "shards", "shard", "lists")
    queries = (member.where("slices > 1").withColumn("slice_", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).where("slice_ <> slice")
               .select("key", F.col("slice_").alias("slice"), F.lit(1).alias("role"), "node", "rep", "weight", "v", "shards", "shard",
                       F.lit(None).cast("array<binary>").alias("lists")))

    def search(batches):
        for t in B.grouped(batches, 2):
            role = t.column("role").to_numpy()
            at = np.flatnonzero(role == 0)
            if not len(at):
                continue
            V = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(t.num_rows, -1)
            x = V.astype(np.float32)
            node, weight, rep = (t.column(c).to_numpy() for c in ("node", "weight", "rep"))
            shards, here = t.column("shards").to_pylist(), t.column("shard")[0].as_py()
            order = np.argsort(node[at], kind="stable")
            known = node[at][order]
            adj = []
            for ls in t.column("lists").take(pa.array(at)).to_pylist():
                a = np.unique(np.concatenate([np.frombuffer(z, np.int64) for z in ls])) if ls else np.zeros(0, np.int64)
                p = np.searchsorted(known, a)
                ok = known[np.minimum(p, len(known) - 1)] == a
                adj.append(order[p[ok & (p < len(known))]])
            X = x[at]
            mean = X.mean(0)
            medoid = int((X @ mean).argmax())
            qi, xi = range_search(x, X, medoid, both_ways(adj), threshold - 1e-4)
            xi = at[xi]
            # verified in double precision; a pair counts in the first shard that both share
            cos = np.einsum("ij,ij->i", V[qi], V[xi])
            ok = (cos >= threshold) & (qi != xi)
            qi, xi = qi[ok], xi[ok]
            if len(qi):
                S = np.full((t.num_rows, max(len(s) for s in shards)), -1)
                for i, s in enumerate(shards):
                    S[i, :len(s)] = s
                lower = np.zeros(len(qi), bool)
                for a in range(S.shape[1]):
                    for c in range(S.shape[1]):
                        lower |= (S[qi, a] == S[xi, c]) & (S[qi, a] >= 0) & (S[qi, a] < here)
                qi, xi = qi[~lower], xi[~lower]
            if not len(qi):
                continue
            # a link that only one of its ends finds counts for both: pairs within the slice are made symmetric
            inside = role[qi] == 0
            pair = np.unique(np.concatenate([qi[inside] * t.num_rows + xi[inside], xi[inside] * t.num_rows + qi[inside],
                                             qi[~inside] * t.num_rows + xi[~inside]]))
            qi, xi = pair // t.num_rows, pair % t.num_rows
            links = np.bincount(qi, weights=weight[xi], minlength=t.num_rows).astype(np.int64)
            forest = Forest(t.num_rows)
            for a, c in zip(qi.tolist(), xi.tolist()):
                forest.join(a, c)
            hit = np.flatnonzero(links)
            root = np.array([forest.find(int(i)) for i in hit], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(rep[hit]), pa.array(rep[root])],
                                             ["node", "links", "a", "b"])

    work = targets.unionAll(queries)
    got = cut_lineage(work.repartition("key", "slice").sortWithinPartitions("key", "slice", "role", "node")
                      .mapInArrow(search, "node bigint, links bigint, a bigint, b bigint"))
    links = got.groupBy("node").agg(F.sum("links").alias("links"))
    many = units.groupBy("id").agg(F.count_distinct("label", "dim", "v").alias("k")).where("k > 1").select("id")
    ids = units.join(nodes.select("label", "dim", "v", "node", "rep", "weight"), ["label", "dim", "v"]).select("id", "node", "rep", "weight").distinct()
    ids = cut_lineage(ids)
    ties = ids.join(many, "id").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(got.where("a <> b").select("a", "b").unionAll(ties).distinct())
    state = cut_lineage(nodes.select("node", "rep", "weight").join(links, "node", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                        .select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                                F.coalesce("component", "rep").alias("component")))
    per_id = ids.select("id", "node").join(state, "node").groupBy("id").agg(F.sum("links").alias("n_links"), F.min("component").alias("component_id"))
    per_id = cut_lineage(per_id)
    widest = max((len(c) for c in centers.value.values()), default=1)
    if audit and overlap < widest and recall(units, per_id, threshold, audit) < min_recall:
        return near_duplicates(embeddings, id, vector, label, threshold, sample, shard, 2 * overlap, cap, audit, min_recall)
    return (src.select("id").distinct().join(per_id, "id", "left")
            .select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"),
                    (F.col("id") == F.coalesce("component_id", "id")).alias("kept")))


def recall(units: DataFrame, per_id: DataFrame, threshold: float, audit: int) -> float:
    """Share of the audited vectors' links that were found; 1 where they have none."""
    r = (audit_links(units, threshold, audit).join(per_id, "id")
         .agg(F.sum(F.least("n_links", "audit_links")), F.sum("audit_links")).first())
    return float(r[0]) / float(r[1]) if r[1] else 1.0


def audit_links(units: DataFrame, threshold: float, audit: int) -> DataFrame:
    """(id, audit_links) of the first ``audit`` ids by a hash, compared with all vectors in blocks. ``audit`` rows are collected."""
    ids = units.groupBy("id").agg(F.min(F.struct("label", "dim", "v")).alias("m")).orderBy(F.xxhash64("id", F.lit(13)), "id").limit(audit)
    rows = ids.select("id", "m.*").collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault((r["label"], r["dim"]), ([], []))[0].append(r["id"])
        groups[(r["label"], r["dim"])][1].append(np.frombuffer(r["v"], np.float64))
    shared = units.sparkSession.sparkContext.broadcast({g: (np.array(i), np.stack(v)) for g, (i, v) in groups.items()})

    def count(batches):
        total: dict = {}
        for b in batches:
            pdf = pd.DataFrame({"id": b.column(0).to_pandas(), "label": b.column(1).to_pandas(), "dim": b.column(2).to_pandas(), "v": b.column(3).to_pylist()})
            for g, part in pdf.groupby(["label", "dim"]):
                if g in shared.value:
                    q, v = shared.value[g]
                    x = np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), -1)
                    hit = (v @ x.T >= threshold) & (q[:, None] != part["id"].to_numpy()[None, :])
                    for i, n in zip(q.tolist(), hit.sum(1).tolist()):
                        total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "n"])

    return units.mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("audit_links"))
