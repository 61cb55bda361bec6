"""Scores of texts under a weighted backoff automaton of smoothed n-grams, learned from the whole corpus.

Tokens are the runs without ASCII white space, A-Z lower-cased, and one end token a text. A state of the automaton is a
context of up to ``order - 1`` tokens that training has seen; an arc (state, token) holds the log-probability of an
n-gram that training has seen, a failure arc leads to the state of the context without its first token and holds the
weight of the mass left for it:

    p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K),    p(w) = (c(w) + 1) / (N + V + 1),

with h' the shorter context; so each context is a distribution over the V tokens seen and one unknown token. A text is
read once from left to right: the state is carried from token to token, an arc adds its log-probability, and where there
is none the failure arc adds its weight and the shorter context tries. All texts of a bucket move together, a token a
step; texts of more than ``SEGMENT`` tokens are read in pieces, each entered from the root ``order - 1`` tokens early, by
when its state is that of the whole text's traversal.

The counts cover all training texts and are never gathered in one place. Texts are dealt to buckets of about
``BUCKET_BYTES``; a bucket asks, by token hash, for the counts of the n-grams in its own texts and gives its own training
counts; the totals come back (only where others add to a count), and with them the bucket has the counts of all arcs
that its texts can reach. N-grams go by 64-bit hashes (``key_bytes`` for
two tokens or more); a part is a range of hashes, and its keys travel in ascending order as compressed differences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.llm import blocks as B

BUCKET_BYTES = 8 << 20
SEGMENT = 1024  # tokens of a text that are read as one piece
ORDER = 3
#: K of the orders 2 and 3, the best of a grid on sf0.1: learned without the ids whose crc32 leaves 2 or 3 modulo 7, read on those that leave 3.
CONCENTRATION = (12800.0, 5.0)
HELD_TOKENS = 4 << 20  # distinct tokens a task of the count holds at once
END = np.uint64(0xA24BAED4963EE407)
BEGIN = np.uint64(0x9FB21C651E98DF25)
_MULT = np.uint64(0xC2B2AE3D27D4EB4F)


def token_stream(texts: pa.Array):
    """Token hashes of all texts, each text followed by END, and the number of tokens of each text (END counts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, off = B.utf8(texts)
    hs, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in B.row_chunks(off):
        data, o = B.utf8(texts.slice(i, j - i))
        s, e, r = B.tokens(data, o, ~B.IS_SPACE)
        h = B.token_hashes(data, s, e, lower=True)
        n = np.bincount(r, minlength=j - i) if len(r) else np.zeros(j - i, np.int64)
        out = np.insert(h, np.cumsum(n), END)
        hs.append(out)
        ns.append(n + 1)
    return np.concatenate(hs), np.concatenate(ns)


def contexts(h: np.ndarray, n: np.ndarray, order: int):
    """For k = 0 .. order - 1, the hash of the k tokens before each position (a text's begin counts as a token; where
    there are fewer than k, 0), and whether there are k."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    pos = np.arange(len(h)) - np.repeat(first, n)
    out = [(np.zeros(len(h), np.uint64), np.ones(len(h), bool))]
    for k in range(1, order):
        ok = pos >= k - 1
        acc = np.zeros(len(h), np.uint64)
        for j in range(k, 0, -1):  # the oldest first
            prev = np.full(len(h), BEGIN)
            prev[j:] = h[:-j] if j else h
            prev[pos == j - 1] = BEGIN
            acc = acc * _MULT + prev + np.uint64(j)
        out.append((np.where(ok, B.mix(acc + np.uint64(k)), np.uint64(0)), ok))
    return out


def key_bytes(size: int) -> int:
    """Bytes of an n-gram's key in a corpus of ``size`` bytes of text: 20 bits more than its tokens may number."""
    return int(min(8, max(5, -(-(int(max(size, 1)).bit_length() + 20) // 8))))


def ngram_keys(h, n, order, width: int = 8):
    """For k = 1 .. order: keys of the k-gram ending at each position (cut to ``width`` bytes from two tokens on), and whether
    it exists."""
    mask = np.uint64((1 << 8 * width) - 1)
    out = []
    for k, (ctx, ok) in enumerate(contexts(h, n, order)):
        out.append((h if k == 0 else B.mix(ctx * np.uint64(0x9E3779B97F4A7C15) + h) & mask, ok))
    return out


def _pack(keys: np.ndarray, width: int) -> bytes:
    """Ascending keys: the differences between neighbours, their lowest bytes first, then the next, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return _squeezed(steps[:, :width].T.tobytes())


def _unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(_expanded(raw, n * width), np.uint8).reshape(width, n).T
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


def _squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _expanded(raw: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(raw, decompressed_size=size, asbytes=True)


def _pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """A byte a count, compressed; 255 for a number that stands in the second value."""
    return _squeezed(np.minimum(counts, 255).astype(np.uint8).tobytes()), counts[counts >= 255].astype(np.int64).tobytes()


def _unpack_counts(small: bytes, large: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(_expanded(small, n), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return out


def _part_of(keys: np.ndarray, parts: int, width: int = 8) -> np.ndarray:
    """Parts are ranges of keys, so that the ascending keys of a part lie close together."""
    return ((keys >> np.uint64(8 * width - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def local_counts(key: np.ndarray, train: np.ndarray):
    """Distinct keys, how often each stands in training texts, and each position's number."""
    u, inv = np.unique(key, return_inverse=True)
    return u, np.bincount(inv, weights=train, minlength=len(u)).astype(np.int64), inv


def _asking_order(keys: np.ndarray, parts: int, width: int):
    """(part, slice of its keys) of a bucket's ascending keys."""
    cut = np.searchsorted(_part_of(keys, parts, width), np.arange(parts + 1))
    return [(p, slice(cut[p], cut[p + 1])) for p in range(parts) if cut[p] < cut[p + 1]]


# a packed row: the keys of a bucket that fall in a part, and how often its training texts have them
_PACKED = "part int, bucket bigint, k int, n int, keys binary, small binary, large binary"


def _requests(bucket: int, found: list[tuple[int, np.ndarray, np.ndarray]], parts: int, width: int):
    cols = [[] for _ in range(7)]
    for k, keys, count in found:
        w = 8 if k == 1 else width
        for p, at in _asking_order(keys, parts, w):
            row = (p, bucket, k, at.stop - at.start, _pack(keys[at], w), *_pack_counts(count[at]))
            for col, x in zip(cols, row):
                col.append(x)
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)],
                    ["part", "bucket", "k", "n", "keys", "small", "large"])


def _opened(t: pa.Table, width: int):
    """Of a part's packed rows of one order: keys, local counts and the row's number of each key."""
    keys, counts, rows = [], [], []
    for i, r in enumerate(t.to_pylist()):
        keys.append(_unpack(r["keys"], r["n"], width))
        counts.append(_unpack_counts(r["small"], r["large"], r["n"]))
        rows.append(np.full(r["n"], i))
    return np.concatenate(keys), np.concatenate(counts), np.concatenate(rows)


def _totals(key, t: pa.Table, width: int) -> pa.Table:
    """Replies of one part: for each bucket and order, what other buckets add to each key it asked for, in its order."""
    cols = [[] for _ in range(5)]
    part = key[0].as_py()
    for k in sorted(set(t.column("k").to_pylist())):
        rows = t.filter(pa.compute.equal(t.column("k"), k))
        keys, counts, row = _opened(rows, 8 if k == 1 else width)
        u, inv = np.unique(keys, return_inverse=True)
        add = np.bincount(inv, weights=counts, minlength=len(u)).astype(np.int64)[inv] - counts
        buckets = rows.column("bucket").to_pylist()
        cut = np.searchsorted(row, np.arange(len(buckets) + 1))
        for i, b in enumerate(buckets):
            x = add[cut[i]:cut[i + 1]]
            if x.any():
                for col, v in zip(cols, (b, k, part, *_pack_counts(x))):
                    col.append(v)
    return pa.table([pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    ["bucket", "k", "part", "small", "large"])


class Automaton:
    """The part of the automaton that a bucket's texts can reach.

    State 0 is the root, state 1 the begin of a text, the others are contexts that training has seen: ``fail`` is the
    state of the context without its first token, ``back`` the weight of the failure arc. Arcs are ascending by ``arc``
    (state times the number of tokens, plus the token), with their probability ``arc_p`` and the state they lead to,
    ``arc_to``. The root fails nowhere: a token that it has no arc for is unknown, has ``unknown`` and leads to the root.
    """

    def __init__(self, h, n, train, order, replies, parts, width, N: int, V: int, texts: int, concentration: list[float]):
        """``texts``: training texts, the count of the begin state; ``concentration``: K of the orders from 2 on."""
        self.n, self.order, self.first = n, order, np.concatenate([[0], np.cumsum(n)[:-1]])
        pos = np.arange(len(h)) - np.repeat(self.first, n)
        self.unknown = 1 / (N + V + 1)
        K = [0.0, *concentration]  # of a context by its length
        fail, back, count = [np.zeros(2, np.int64)], [np.array([1.0, K[1] / (texts + K[1]) if order > 1 else 1.0])], [np.array([N, texts])]
        states = 2
        at_level = [np.zeros(len(h), np.int64)]  # of each position, the state of the context of k tokens that ends there
        low = None
        arcs = []
        for k, (key, ok) in enumerate(ngram_keys(h, n, order, width), 1):
            u, total, inv = local_counts(key[ok], train[ok])
            for p, at in _asking_order(u, parts, 8 if k == 1 else width):
                if (k, p) in replies:
                    total[at] += _unpack_counts(*replies[(k, p)], at.stop - at.start)
            where = np.flatnonzero(ok)
            if k == 1:
                self.token, self.tokens = inv, max(len(u), 1)
                self.known, self.base = total[inv] > 0, (total[inv] + 1) / (N + V + 1)
            place = np.zeros(len(u), np.int64)
            place[inv] = where  # one place of each n-gram
            seen = np.flatnonzero(total)
            place, total = place[seen], total[seen]
            before = at_level[k - 1][place - 1] if k > 1 else np.zeros(len(seen), np.int64)
            if k == 1:
                prob = (total + 1) / (N + V + 1)
            else:
                before = np.where(pos[place] == 0, 1, before)
                prob = (total + K[k - 1] * low[place]) / (np.concatenate(count)[before] + K[k - 1])
            number = np.full(len(u), -1)
            goes = h[place] != END  # nothing follows the end: its arcs lead to the root
            if k < order:
                to = np.where(goes, states + np.cumsum(goes) - 1, 0)
                number[seen] = np.where(goes, to, -1)
                states += int(goes.sum())
                fail.append(at_level[k - 1][place[goes]])
                back.append(K[k] / (total[goes] + K[k]))
                count.append(total[goes])
                here = np.full(len(h), -1)
                here[where] = number[inv]
                at_level.append(here)
                chance = np.zeros(len(u))
                chance[seen] = prob
                low = np.zeros(len(h))
                low[where] = chance[inv]
            else:
                to = np.where(goes, at_level[k - 1][place], 0)
            arcs.append((before * self.tokens + self.token[place], prob, to))
        key, prob, to = (np.concatenate(x) for x in zip(*arcs))
        by = np.argsort(key)
        self.arc, self.arc_p, self.arc_to = key[by], prob[by], to[by]
        self.fail, self.back = np.concatenate(fail), np.concatenate(back)

    def _pieces(self):
        """(first token, token after the last, tokens read to reach the state, first state) of the pieces, longest first."""
        count = -(-self.n // SEGMENT)
        text = np.repeat(np.arange(len(self.n)), count)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        begin, end = self.first[text] + at, self.first[text] + np.minimum(at + SEGMENT, self.n[text])
        warm = np.where(at > 0, self.order - 1, 0)
        by = np.argsort(begin - warm - end, kind="stable")
        return (begin - warm)[by], end[by], warm[by], np.where(at > 0, 0, 1 if self.order > 1 else 0)[by]

    def _step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the tokens after the states, failure arcs followed, and the states that they lead to."""
        p, todo = np.ones(len(state)), np.arange(len(state))
        state = state.copy()
        while len(todo):
            key = state[todo] * self.tokens + token[todo]
            a = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[a] == key if len(self.arc) else np.zeros(len(todo), bool)
            lost = ~hit & (state[todo] == 0)
            p[todo[lost]] *= self.unknown
            p[todo[hit]] *= self.arc_p[a[hit]]
            state[todo[hit]] = self.arc_to[a[hit]]
            todo = todo[~hit & ~lost]
            p[todo] *= self.back[state[todo]]
            state[todo] = self.fail[state[todo]]
        return p, state

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n_known, base score, score) of each text."""
        begin, end, warm, state = self._pieces()
        size = end - begin
        out = np.ones(len(self.token))
        left = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # pieces with a token at each step
        for step, m in enumerate(left.tolist()):
            at = begin[:m] + step
            p, state = self._step(state[:m], self.token[at])
            mine = warm[:m] <= step
            out[at[mine]] = p[mine]
        add = lambda x: np.add.reduceat(x, self.first) if len(self.first) else np.zeros(0)
        return add(self.known.astype(np.int64)), add(np.log10(self.base)), add(np.log10(out))


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", learn=None, order: int = ORDER,
          concentration: float | tuple[float, ...] = CONCENTRATION) -> DataFrame:
    """One row a row of ``docs``: the id, ``held_out`` boolean, ``n_tokens``, ``n_known``, ``train_tokens`` long,
    ``base_score`` double (add-one unigrams) and ``score`` double (the automaton), both log10 probabilities.

    ``learn`` maps the id column to a boolean: learn from these rows (null: not; default: all). A null text is empty and
    has the end token only. With no training rows N = V = 0 and every token has probability 1. Repeated rows count each
    time. An empty table gives an empty result. ``concentration`` is K, one value or one for each order from 2 on; the
    last holds for the orders above.
    """
    from pyspark.sql import types as T

    given = (concentration,) if isinstance(concentration, (int, float)) else tuple(concentration)
    strength = [float(given[min(k, len(given) - 1)]) for k in range(order - 1)]
    spark = docs.sparkSession
    key = F.col(f"`{id}`")
    want = F.coalesce(learn(key), F.lit(False)) if learn is not None else F.lit(True)
    src = docs.select(key.alias("id"), want.alias("train"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    size = src.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-int(size) // BUCKET_BYTES))
    width = key_bytes(int(size))
    N, V, texts = _corpus_counts(src.where("train").select("t"), buckets)

    spread = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("t")))
    dealt = src.withColumn("bucket", F.pmod(spread, F.lit(buckets))).repartition(buckets, "bucket")
    id_type = src.schema["id"].dataType

    def ask(t: pa.Table) -> pa.Table:
        h, n = token_stream(t.column("t"))
        train = np.repeat(np.asarray(t.column("train").to_numpy(zero_copy_only=False), bool), n)
        found = []
        for k, (keys, ok) in enumerate(ngram_keys(h, n, order, width), 1):
            u, c, _ = local_counts(keys[ok], train[ok])
            found.append((k, u, c))
        return _requests(t.column("bucket")[0].as_py(), found, buckets, width)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        h, n = token_stream(left.column("t"))
        train = np.asarray(left.column("train").to_numpy(zero_copy_only=False), bool)
        replies = {(r["k"], r["part"]): (r["small"], r["large"]) for r in right.to_pylist()}
        known, base, got = Automaton(h, n, np.repeat(train, n), order, replies, buckets, width, N, V, texts, strength).read()
        return pa.table([left.column("id"), pa.array(~train), pa.array(n), pa.array(known), pa.array(np.full(len(n), N)),
                         pa.array(base), pa.array(got)], out.names)

    out = T.StructType([T.StructField(id, id_type), *T.StructType.fromDDL(
        "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")])
    asked = dealt.groupBy("bucket").applyInArrow(lambda t: ask(t), _PACKED)
    replies = asked.repartition(buckets, "part").groupBy("part").applyInArrow(
        lambda k, t: _totals(k, t, width), "bucket bigint, k int, part int, small binary, large binary")
    return dealt.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(lambda a, b: answer(a, b), out)


def _corpus_counts(train: DataFrame, parts: int) -> tuple[int, int, int]:
    """Tokens, distinct tokens and texts of the training rows: each task's distinct tokens meet by hash."""
    def distinct(batches):
        held, n_held, n, texts = [], 0, 0, 0
        for b in batches:
            _, off = B.utf8(b.column(0))
            for i, j in B.row_chunks(off):
                h, k = token_stream(b.column(0).slice(i, j - i))
                held.append(np.unique(h))
                n_held, n, texts = n_held + len(held[-1]), n + len(h), texts + len(k)
                if n_held > HELD_TOKENS:
                    yield packed(held, n, texts)
                    held, n_held, n, texts = [], 0, 0, 0
        if held:
            yield packed(held, n, texts)

    def packed(held, n, texts):
        u = np.unique(np.concatenate(held))
        part = _part_of(u, parts)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        m, t = np.zeros((2, len(some)), np.int64)
        m[:1], t[:1] = n, texts
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([u[order[cut[p]:cut[p + 1]]].tobytes() for p in some], pa.binary()),
                                           pa.array(m), pa.array(t)], ["part", "keys", "n", "texts"])

    def count(k, t: pa.Table) -> pa.Table:
        u = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]))
        return pa.table([[len(u)], [pa.compute.sum(t.column("n")).as_py()], [pa.compute.sum(t.column("texts")).as_py()]], ["v", "n", "texts"])

    got = train.mapInArrow(distinct, "part int, keys binary, n bigint, texts bigint").repartition(parts, "part").groupBy(
        "part").applyInArrow(lambda k, t: count(k, t), "v bigint, n bigint, texts bigint")
    r = got.agg(F.sum("n"), F.sum("v"), F.sum("texts")).first()
    return int(r[0] or 0), int(r[1] or 0), int(r[2] or 0)
