"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words (lower-cased runs of letters and digits; a text of one to four words has one
shingle of them all). Texts of equal sets form a class, which is joined once for all its documents. Per class
``HASHES`` MinHash values give ``BANDS`` band keys; classes that share a band key meet. Their MinHash values are
compared in steps of ``STEP``, and a pair is dropped as soon as the posterior probability (uniform prior) that its
similarity reaches the threshold is below ``tolerance``. The pairs left join classes to candidate groups; within a
group every pair of classes is verified exactly on its shingle sets.

Meetings of many classes are split into pairs of blocks of at most ``block`` classes, each a task's worth, so none is
cut short: no bucket, partner or candidate is capped. Links are counted where they are verified and never written as
pairs; only a forest of each block's links is, for the components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.llm import blocks as B
from gustlab.llm.components import components
from gustlab.session import cut_lineage

HASHES, BANDS, STEP = 128, 32, 16
MAX_BIT_BYTES = 64 << 20
_G = np.random.Generator(np.random.PCG64(5))
_MULT = _G.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def minhash(sh: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """MinHash values [n, HASHES] (32 bits each) of rows of shingles, the rows in order; all ones for an empty row."""
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    if len(sh):
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for k in range(HASHES):
            out[row[at], k] = np.minimum.reduceat(((sh * _MULT[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def shingle_sets(data: np.ndarray, off: np.ndarray):
    """Sorted distinct shingles of each row of a chunk, and their row numbers."""
    s, e, row = B.tokens(data, off, B.IS_WORD)
    sh, r = B.shingles(B.token_hashes(data, s, e), row, len(off) - 1)
    order = np.lexsort((sh, r))
    sh, r = sh[order], r[order]
    if len(sh):
        keep = np.append(True, (sh[1:] != sh[:-1]) | (r[1:] != r[:-1]))
        sh, r = sh[keep], r[keep]
    return sh, r


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step, the fewest equal MinHash values with which P(similarity >= threshold) is at least ``tolerance``."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        m = 0
        for m in range(n + 1):
            logp = m * np.log(x) + (n - m) * np.log1p(-x) + math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
            p = np.exp(logp)
            if p[x >= threshold].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return out


class Forest:
    """Union-find over 0..n-1; the smallest number is the root."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def similar(sig: np.ndarray, left: np.ndarray, right: np.ndarray, fewest: list[int]):
    """Pairs (i of ``left`` before j of ``right``, as rows of ``sig``) that stay in after all steps of the comparison."""
    for i in left:
        js = right[right > i]
        got = np.zeros(len(js), np.int32)
        for k, least in enumerate(fewest):
            if not len(js):
                break
            got = got + (sig[js, k * STEP:(k + 1) * STEP] == sig[i, k * STEP:(k + 1) * STEP]).sum(1)
            ok = got >= least
            js, got = js[ok], got[ok]
        if len(js):
            yield int(i), js


def _runs(table):
    """Row numbers of the left and the right block of a group's rows (equal where a block meets itself)."""
    side = table.column("side").to_numpy()
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def blocked(df: DataFrame, key: str, count: str, member: str, block: int) -> DataFrame:
    """Rows of each ``key`` dealt to pairs of blocks: columns ``bi`` <= ``bj`` and ``side`` (0: block bi, 1: block bj,
    2: both). A key of at most ``block`` rows has the single pair (0, 0)."""
    n = F.ceil(F.col(count) / F.lit(block)).cast("int")
    return (df.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(member, F.lit(3)), F.col("_n")).cast("int"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            .withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o"))
            .withColumn("side", F.when(F.col("bi") == F.col("bj"), 2).when(F.col("_b") == F.col("bi"), 0).otherwise(1))
            .drop("_n", "_b", "_o"))


def _dealt(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each group of ``keys`` in one task, groups one after the other."""
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-6,
         block: int = 1024) -> DataFrame:
    """One row a distinct id: the id, ``n_links`` long (other documents of similarity >= ``threshold``, copies included),
    ``component_id`` long (the smallest id reachable by links, itself included) and ``kept`` boolean (id =
    component_id).

    Texts that are null or have no word link with nothing. Rows with a null id are left out. Rows that share an id
    count as one document for each distinct shingle set: their links add up, their components are one. An empty table
    gives an empty result.
    """
    src = docs.select(F.col(id).cast("bigint").alias("id"), F.lower(F.col(text)).alias("t")).where("id is not null")

    def sign(batches):
        for b in batches:
            _, off = B.utf8(b.column(1))
            for i, j in B.row_chunks(off):
                data, o = B.utf8(b.column(1).slice(i, j - i))
                n = j - i
                sh, r = shingle_sets(data, o)
                sig = minhash(sh, r, n)
                size = np.bincount(r, minlength=n) if len(r) else np.zeros(n, np.int64)
                first = np.concatenate([[0], np.cumsum(size)])
                both = np.zeros((2, len(sh) + 1), np.uint64)
                for k in range(2):  # sums over a set, so equal for equal sets only (but for chance of 2^-128)
                    np.cumsum(B.mix(sh + np.uint64(k + 1)), out=both[k, 1:])
                dig = [(both[k][first[1:]] - both[k][first[:-1]]).view(np.int64) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(dig[0]), pa.array(dig[1]), pa.array(size.astype(np.int64)),
                     pa.array([sig[x].tobytes() for x in range(n)], pa.binary())], ["id", "d1", "d2", "size", "sig"])

    signed = cut_lineage(src.mapInArrow(sign, "id bigint, d1 bigint, d2 bigint, size bigint, sig binary"))
    sets = signed.where("size > 0")
    # a class: documents of one shingle set; its representative is the smallest id
    classes = cut_lineage(sets.groupBy("d1", "d2").agg(F.min(F.struct("id", "sig")).alias("m"), F.countDistinct("id").alias("weight"))
                          .select("d1", "d2", F.col("m.id").alias("rep"), F.col("m.sig").alias("sig"), "weight"))

    links, forest = _class_links(docs, classes, id, text, threshold, tolerance, block)
    # ids that stand for several sets, and classes, tie components as well
    member = sets.join(classes.select("d1", "d2", "rep", "weight"), ["d1", "d2"]).select("id", "rep", "weight", "d1", "d2")
    many = sets.groupBy("id").agg(F.count_distinct("d1", "d2").alias("k")).where("k > 1").select("id")
    ties = member.join(many, "id").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(forest.unionAll(ties).distinct())
    found = (classes.select("d1", "d2", "rep", "weight").join(links, ["d1", "d2"], "left")
             .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
             .select("d1", "d2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                     F.coalesce("component", "rep").alias("component")))
    found = cut_lineage(found)
    return (signed.select("id", "d1", "d2", "size").distinct()
            .join(found, ["d1", "d2"], "left")
            .groupBy("id").agg(F.sum(F.when(F.col("size") > 0, F.col("links")).otherwise(0)).alias("n_links"),
                               F.min(F.when(F.col("size") > 0, F.col("component"))).alias("component"))
            .select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.col(id) == F.col("component_id")))


def _class_links(docs, classes, id, text, threshold, tolerance, block):
    """(d1, d2, links): documents of other classes each class links with; and the edges of a forest of these links."""
    rows_per_band = HASHES // BANDS

    def bands(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, HASHES) if b.num_rows else np.zeros((0, HASHES), np.uint32)
            n = len(sig)
            key = np.zeros((n, BANDS), np.uint64)
            for k in range(rows_per_band):
                key = B.mix(key * np.uint64(31) + sig[:, k::rows_per_band].astype(np.uint64) + np.uint64(k + 1))
            key = B.mix(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)),
                                              pa.array(np.repeat(np.asarray(b.column(0)), BANDS)),
                                              pa.array(np.repeat(np.asarray(b.column(1)), BANDS))], ["key", "d1", "d2"])

    keys = classes.select("d1", "d2", "sig").mapInArrow(bands, "key bigint, d1 bigint, d2 bigint")
    keys = cut_lineage(keys)
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("d1", "d2")).alias("x"),
                                      F.sum(F.xxhash64("d1", "d2").bitwiseAND(F.lit((1 << 40) - 1))).alias("y")).where("n > 1")
    # bands that gather the same classes say the same: one of them is enough
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    meet = cut_lineage(keys.join(cut_lineage(buckets), "key"))
    meet = meet.join(classes.select("d1", "d2", "sig"), ["d1", "d2"])
    meet = blocked(meet, "key", "n", "d2", block).select("key", "bi", "bj", "side", "d1", "d2", "sig")
    fewest = fewest_matches(threshold, tolerance)

    def compare(batches):
        for t in B.grouped(batches, 3):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            left, right = _runs(t)
            forest = Forest(len(sig))
            if len(left) and len(right):
                split = bool((t.column("side").to_numpy() != 2).any())
                # two different blocks meet: put the left one first so each pair is seen once
                order = np.concatenate([left, right]) if split else np.arange(len(sig))
                s = sig[order]
                a = np.arange(len(left)) if split else order
                c = np.arange(len(left), len(order)) if split else order
                for i, js in similar(s, a, c, fewest):
                    for j in js:
                        forest.join(int(order[i]), int(order[j]))
            root = np.array([forest.find(i) for i in range(len(sig))])
            at = np.flatnonzero(root != np.arange(len(sig)))
            if len(at):
                d1, d2 = t.column("d1").to_numpy(), t.column("d2").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1[at], d2[at], d1[root[at]], d2[root[at]])],
                                                 ["a1", "a2", "b1", "b2"])

    pairs = _dealt(meet, ["key", "bi", "bj"], "d2").mapInArrow(compare, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    # from here classes go by their representative; those of one id (an id with several texts) go together
    name = classes.select("d1", "d2", "rep", "weight")
    cand = components(cut_lineage(pairs.distinct())
                      .join(name.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("rep").alias("a")), ["a1", "a2"])
                      .join(name.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("rep").alias("b")), ["b1", "b2"])
                      .select("a", "b"))
    cand = cut_lineage(cand.withColumnRenamed("node", "rep").join(name, "rep"))
    sizes = cand.groupBy("component").agg(F.count("*").alias("n"))
    src = docs.select(F.col(id).cast("bigint").alias("rep"), F.lower(F.col(text)).alias("t"))
    texts = src.join(cand.select("rep").distinct(), "rep")

    def sets(batches):
        for b in batches:
            _, off = B.utf8(b.column(1))
            for i, j in B.row_chunks(off):
                sh, r = shingle_sets(*B.utf8(b.column(1).slice(i, j - i)))
                cut = np.searchsorted(r, np.arange(j - i + 1))
                d = [[int(B.mix(sh[x:y] + np.uint64(k + 1)).sum(dtype=np.uint64)) for x, y in zip(cut, cut[1:])] for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.array(x, np.uint64).view(np.int64)) for x in d],
                     pa.array([sh[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], ["d1", "d2", "sh"])

    have = texts.mapInArrow(sets, "d1 bigint, d2 bigint, sh binary").dropDuplicates(["d1", "d2"])
    group = have.join(cand.join(sizes, "component"), ["d1", "d2"])
    group = blocked(group, "component", "n", "d2", block).select("component", "bi", "bj", "side", "rep", "d1", "d2", "weight", "sh")

    def verify(batches):
        for t in B.grouped(batches, 3):
            out = exact_links([np.frombuffer(x, np.uint64) for x in t.column("sh").to_pylist()],
                              t.column("weight").to_numpy(), t.column("side").to_numpy(), threshold)
            if out is None:
                continue
            count, forest = out
            at = np.flatnonzero(count)
            root = np.array([forest.find(int(i)) for i in at], np.int64)
            rep = t.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(t.column("d1").to_numpy()[at]), pa.array(t.column("d2").to_numpy()[at]),
                                              pa.array(count[at]), pa.array(rep[at]), pa.array(rep[root])],
                                             ["d1", "d2", "links", "a", "b"])

    got = cut_lineage(_dealt(group, ["component", "bi", "bj"], "rep")
                      .mapInArrow(verify, "d1 bigint, d2 bigint, links bigint, a bigint, b bigint"))
    return got.groupBy("d1", "d2").agg(F.sum("links").alias("links")), got.where("a <> b").select("a", "b").distinct()


def exact_links(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, threshold: float):
    """Weight of the linked partners of each set, and a forest of the links: pairs of Jaccard similarity >= threshold
    between block 0 and block 1, or within block 2. Shingles become bit columns (those of one set only are left out,
    they add nothing to an
    intersection), and pairs are compared row by row against all that follow; where the bits would take over
    MAX_BIT_BYTES, the shingle lists are counted instead."""
    n = len(sets)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right) or n < 2:
        return None
    size = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, inv, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df > 1
    number = np.cumsum(shared) - 1
    use = shared[inv]
    col, row = number[inv[use]], row[use]
    width = int(shared.sum())
    words = -(-max(width, 1) // 64)
    dense = n * words * 8 <= MAX_BIT_BYTES
    if dense:
        bits = np.zeros((n, words), np.uint64)
        np.bitwise_or.at(bits, (row, col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
    count, forest = np.zeros(n, np.int64), Forest(n)
    same = bool((side == 2).all())
    step = max(1, (32 << 20) // (words * 8)) if dense else n
    for x, i in enumerate(left):
        js = left[x + 1:] if same else right
        # sizes alone may rule a pair out
        js = js[np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i]) - 1e-9]
        for k in range(0, len(js), step):
            j = js[k:k + step]
            if dense:
                inter = np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)
            else:
                mark = np.zeros(width, bool)
                mark[col[row == i]] = True
                inter = np.bincount(row[mark[col]], minlength=n)[j]
            hit = j[inter >= threshold * (size[j] + size[i] - inter) - 1e-9]
            if len(hit):
                count[i] += weight[hit].sum()
                count[hit] += weight[i]
                for h in hit:
                    forest.join(int(i), int(h))
    return count, forest
