"""A Merkle manifest of a dataset: a leaf a row, a tree a group, a root over the groups' trees, and proofs a row.

Parents keep a copy of their SHA-256 state before each child slot. Folding a changed child resumes the copy of its
slot with the replacement and the siblings to its right only; what stands to its left is never hashed again.

The rows are dealt to ranges of (group, id), so that a row's place in its group is a count per range plus its place
in the range. A task holds subtrees of ``FAN ** LEVELS`` consecutive nodes, whatever the size of the group: one pass
climbs from rows to roots, a step of ``LEVELS`` levels a job, and one pass hands the way to the root (the
siblings of each level) down again to the subtrees of the rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustlab.llm.mixing import ranked
from gustlab.session import cut_lineage

FAN = 16
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64  # characters of a digest


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field is ``-`` if null, else its bytes in UTF-8, a colon and the value (integers decimal)."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text.cast("string"), upper, upper.lower())


def depth(nodes: int, fan: int = FAN) -> int:
    """Levels above ``nodes`` nodes."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // fan), n + 1
    return n


class Subtree:
    """The levels above some consecutive nodes that begin a run, with the states of all parents."""

    def __init__(self, nodes: list[bytes], levels: int, fan: int = FAN):
        self.fan = fan
        self.states: list[list] = []  # by level: the state of the parent before each child
        self.runs: list[list[bytes]] = []  # by level: the joined digests of each parent's children
        for _ in range(levels):
            before, runs, up = [], [], []
            for i in range(0, len(nodes), fan):
                s = hashlib.sha256()
                for child in nodes[i:i + fan]:
                    before.append(s.copy())
                    s.update(child)
                runs.append(b"".join(nodes[i:i + fan]))
                up.append(s.hexdigest().encode())
            self.states.append(before)
            self.runs.append(runs)
            nodes = up
        self.top = nodes

    def siblings(self, level: int, i: int) -> tuple[bytes, bytes]:
        """The digests to the left and to the right of node ``i`` of a level, in its run."""
        run, at = self.runs[level][i // self.fan], i % self.fan * _HEX
        return run[:at], run[at + _HEX:]

    def fold(self, i: int, value: bytes) -> bytes:
        """The digest at the top if the digest of the ``i``-th node were ``value``."""
        for level, before in enumerate(self.states):
            s = before[i].copy()
            s.update(value)
            s.update(self.siblings(level, i)[1])
            value, i = s.hexdigest().encode(), i // self.fan
        return value


def _subtree(nodes: pa.Table, fan: int, levels: int) -> Subtree:
    total = nodes.column("total")[0].as_py()
    return Subtree([x.encode() for x in nodes.column("node").to_pylist()], min(levels, depth(total, fan)), fan)


def _climb(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """From (grp, pos, total, node): that table and those of every ``levels``-th level above, to one node a group."""
    span = fan ** levels
    steps = [nodes]
    while not steps[-1].where("total > 1").isEmpty():
        def up(key, t):
            tree, total = _subtree(t.sort_by("pos"), fan, levels), t.column("total")[0].as_py()
            return pa.table({"grp": [key[0].as_py()], "pos": [key[1].as_py()], "total": [-(-total // span)],
                             "node": [x.decode() for x in tree.top]})

        below = steps[-1]
        dealt = below.groupBy("grp", F.expr(f"pos div {span}").alias("bucket"))
        steps.append(cut_lineage(dealt.applyInArrow(up, "grp long, pos long, total long, node string")))
    return steps


_PATH = "grp long, bucket long, lefts array<string>, rights array<string>, subroot string, root string"


def _descend(steps: list[DataFrame], paths: DataFrame, fan: int, levels: int) -> DataFrame:
    """From the paths (``_PATH``) of the nodes above the last of ``steps`` those of the nodes of the first, with their digest
    ``node``; a node's ``bucket`` is its place, and the number of the subtree below it."""
    span = fan ** levels

    def down(key, nodes, path):
        nodes, p = nodes.sort_by("pos"), path.to_pylist()[0]
        tree = _subtree(nodes, fan, levels)
        lefts, rights = [], []
        for i in range(nodes.num_rows):
            way = [tree.siblings(k, i // fan ** k) for k in range(len(tree.states))]
            lefts.append([a.decode() for a, _ in way] + p["lefts"])
            rights.append([b.decode() for _, b in way] + p["rights"])
        n, texts = nodes.num_rows, pa.list_(pa.string())
        return pa.table({"grp": pa.array([key[0].as_py()] * n, pa.int64()), "bucket": nodes.column("pos"),
                         "lefts": pa.array(lefts, texts), "rights": pa.array(rights, texts), "subroot": [p["subroot"]] * n,
                         "root": [p["root"]] * n, "node": nodes.column("node")})

    for step in reversed(steps):
        dealt = step.groupBy("grp", F.expr(f"pos div {span}").alias("bucket"))
        paths = cut_lineage(dealt.cogroup(paths.groupBy("grp", "bucket")).applyInArrow(down, _PATH + ", node string"))
    return paths


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``grp``, the group's rank, ``pos``, the row's place in it, and ``total``; groups with their rank as ``rank``).

    Rows come by (source, id, leaf), nulls first; ranges are the same for all readers, since they are written down."""
    keys = [F.col(c).asc_nulls_first() for c in ("source", "id", "leaf")]
    dealt = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
                        .withColumn("at", F.expr("monotonically_increasing_id() & 8589934591")))
    counts = cut_lineage(dealt.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    groups = ranked(counts.groupBy("source").agg(F.sum("n").alias("total")))
    if not groups.where("source is null").isEmpty():  # ranked last, asked for first
        groups = groups.withColumn("rank", F.when(F.col("source").isNull(), 0).otherwise(F.col("rank") + 1))
    groups = cut_lineage(groups.select("source", "total", F.col("rank").cast("long").alias("rank")))
    before = F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).alias("c").join(
        groups.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(
        F.col("part").alias("_part"), F.col("c.source").alias("_source"), F.col("rank").alias("grp"), "total",
        (F.col("before") - F.col("first")).alias("shift"))
    placed = dealt.join(offsets, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))).select(
        "grp", (F.col("at") + F.col("shift")).cast("long").alias("pos"), "total", F.col("leaf").alias("node"), "id", "changed")
    return cut_lineage(placed), groups


def _trees(docs: DataFrame, id: str, group: str, fields, changed: dict[str, Column], tampered: Column | None, fan: int, levels: int):
    cols = [F.col(f"`{c}`") for c in fields]
    other = leaf([changed.get(c, F.col(f"`{c}`")) for c in fields])
    rows = docs.select(F.col(f"`{group}`").cast("string").alias("source"), F.col(f"`{id}`").alias("id"), leaf(cols).alias("leaf"),
                       (F.when(tampered, other) if tampered is not None else F.lit(None).cast("string")).alias("changed"))
    placed, groups = _placed(rows)
    steps = _climb(placed.select("grp", "pos", "total", "node"), fan, levels)
    subroots = groups.select("rank", "source", "total").join(
        steps[-1].select(F.col("grp").alias("rank"), F.col("node").alias("subroot")), "rank")
    subroots = cut_lineage(subroots)
    n = subroots.count()
    over = _climb(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("rank").alias("pos"), F.lit(n).cast("long").alias("total"),
                                  F.col("subroot").alias("node")), fan, levels)
    return placed, steps, subroots, over


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "source", fields=FIELDS, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """A row per group: ``rank`` long, ``source``, ``leaves`` long, ``subroot`` and ``root`` (the same in all rows). An empty table
    has no row and no root."""
    _, _, subroots, over = _trees(docs, id, group, fields, {}, None, fan, levels)
    root = over[-1].first()
    return subroots.select("rank", "source", F.col("total").alias("leaves"), "subroot",
                           F.lit(root["node"] if root else None).cast("string").alias("root"))


def proofs(docs: DataFrame, id: str = "doc_id", group: str = "source", fields=FIELDS, changed: dict[str, Column] | None = None,
           tampered: Column | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """A row per row of ``docs``: the id, ``leaf``, ``subroot``, ``root``, ``proof`` (the digests of the siblings, level by level up to
    the root, left to right), ``folded_root`` and ``verified`` (equals the root).

    A row's leaf is the digest of its ``fields`` (:func:`leaf`). In a group leaves ascend by id, then by digest, nulls
    first; while more than one node remains, every ``fan`` consecutive ones become one. The groups' roots, by group (null
    first, bytewise), become the root likewise. Where ``tampered`` holds, the folded root comes from the leaf of the row
    with the columns ``changed`` in place, else from its own leaf, and in both cases from the original siblings. Repeated
    rows keep a leaf and a row each. Other columns of ``docs`` take no part; an empty table gives an empty result.
    """
    placed, steps, subroots, over = _trees(docs, id, group, fields, changed or {}, tampered, fan, levels)
    none = F.array().cast("array<string>")
    top = over[-1].select("grp", F.lit(0).cast("long").alias("bucket"), none.alias("lefts"), none.alias("rights"),
                          F.lit("").alias("subroot"), F.col("node").alias("root"), "node")
    # a group's way to the root is the path of its own top node
    ways = _descend(over[:-1], top, fan, levels).select(F.col("bucket").alias("grp"), F.lit(0).cast("long").alias("bucket"), "lefts",
                                                        "rights", F.col("node").alias("subroot"), "root")
    paths = _descend(steps[1:-1], ways, fan, levels)
    id_type = placed.schema["id"].dataType.simpleString()
    span = fan ** levels

    def fold(key, rows, path):
        rows, p = rows.sort_by("pos"), path.to_pylist()[0]
        tree, leaves = _subtree(rows, fan, levels), rows.column("node").to_pylist()
        upper = [(hashlib.sha256(a.encode()), b.encode()) for a, b in zip(p["lefts"], p["rights"])]
        tail = "".join(a + b for a, b in zip(p["lefts"], p["rights"]))
        proof, folded = [], []
        for i, (own, new) in enumerate(zip(leaves, rows.column("changed").to_pylist())):
            value = tree.fold(i, (own if new is None else new).encode())
            for state, right in upper:
                s = state.copy()
                s.update(value)
                s.update(right)
                value = s.hexdigest().encode()
            folded.append(value.decode())
            way = (tree.siblings(k, i // fan ** k) for k in range(len(tree.states)))
            proof.append(b"".join(a + b for a, b in way).decode() + tail)
        n = len(leaves)
        return pa.table({"id": rows.column("id"), "leaf": rows.column("node"), "subroot": [p["subroot"]] * n, "root": [p["root"]] * n,
                         "proof": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()),
                         "verified": [f == p["root"] for f in folded]})

    dealt = placed.groupBy("grp", F.expr(f"pos div {span}").alias("bucket")).cogroup(paths.groupBy("grp", "bucket"))
    got = dealt.applyInArrow(fold, f"id {id_type}, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    return got.withColumnRenamed("id", id)


# the table of four bits of crc32, from its polynomial
_NIBBLES = [0] * 16
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _NIBBLES[_i] = _c

ORACLE = f"""
    WITH RECURSIVE t AS (SELECT {_NIBBLES}::BIGINT[] AS nib),
    d AS (SELECT doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                 xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                                 lambda a, b: xor(xor(xor(a, b) >> 4, nib[1 + (xor(a, b) & 15)]) >> 4,
                                                  nib[1 + (xor(xor(a, b) >> 4, nib[1 + (xor(a, b) & 15)]) & 15)]),
                                 4294967295::BIGINT), 4294967295) AS crc FROM documents, t),
    f AS (SELECT doc_id, source, crc, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda x:
                 coalesce(octet_length(encode(x))::VARCHAR || ':' || x, '-')) AS own,
                 coalesce(octet_length(encode(low))::VARCHAR || ':' || low, '-') AS low FROM d),
    h AS (SELECT doc_id, source, sha256(array_to_string(own, '')) AS leaf,
                 CASE WHEN crc % 5 = 0 THEN sha256(array_to_string(own[1:4], '') || low) END AS bad FROM f),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                 count(*) OVER (PARTITION BY source) AS n FROM h),
    lv AS (SELECT 0 AS l, source, pos, n, leaf AS h FROM p
           UNION ALL SELECT l + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1
           GROUP BY l, source, n, pos // 16),
    s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
    rv AS (SELECT 0 AS l, pos, n, subroot AS h FROM s
           UNION ALL SELECT l + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM rv WHERE n > 1
           GROUP BY l, n, pos // 16),
    runs AS (SELECT l, source, pos // 16 AS run, n, list(h ORDER BY pos) AS hs FROM lv WHERE n > 1 GROUP BY l, source, n, pos // 16),
    tops AS (SELECT l, pos // 16 AS run, n, list(h ORDER BY pos) AS hs FROM rv WHERE n > 1 GROUP BY l, n, pos // 16),
    walk AS (SELECT doc_id, source, leaf, 0 AS l, pos AS at, n, coalesce(bad, leaf) AS v, '' AS proof FROM p
             UNION ALL SELECT doc_id, w.source, leaf, w.l + 1, w.at // 16, (w.n + 15) // 16,
                 sha256(array_to_string(list_concat(list_concat(hs[1:(w.at % 16)], [v]), hs[(w.at % 16) + 2:]), '')),
                 proof || array_to_string(list_concat(hs[1:(w.at % 16)], hs[(w.at % 16) + 2:]), '')
             FROM walk w JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.l = w.l AND r.run = w.at // 16 WHERE w.n > 1),
    up AS (SELECT w.doc_id, w.leaf, s.subroot, 0 AS l, s.pos AS at, s.n, w.v, w.proof FROM walk w JOIN s ON s.source IS NOT DISTINCT FROM w.source
           WHERE w.n = 1
           UNION ALL SELECT doc_id, leaf, subroot, w.l + 1, w.at // 16, (w.n + 15) // 16,
                 sha256(array_to_string(list_concat(list_concat(hs[1:(w.at % 16)], [v]), hs[(w.at % 16) + 2:]), '')),
                 proof || array_to_string(list_concat(hs[1:(w.at % 16)], hs[(w.at % 16) + 2:]), '')
           FROM up w JOIN tops r ON r.l = w.l AND r.run = w.at // 16 WHERE w.n > 1)
    SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = h AS verified
    FROM up, (SELECT h FROM rv WHERE n = 1) WHERE up.n = 1
"""
