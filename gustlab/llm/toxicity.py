"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in NumPy.

Inputs: a text is lower-cased and cut into words (runs of letters and digits). A word's vector joins a learned word
vector (zero for words outside the vocabulary of the sample) with the sum of learned vectors of its character 3- to
5-grams, word edges included. Windows of ``WINDOW`` words with a stride of ``STRIDE`` overlap; two gated recurrent
passes, one each way, read a window, attention weighs the positions, and a logistic unit scores the pooled state. A
document is judged by its highest windows over its whole text: a second logistic unit, fitted on a quarter of the sample
that the network does not see, weighs the ``TOP`` highest window scores and the number of windows (a sample of under
``MIN_JOINT`` documents goes by the highest window alone).

Training uses a bounded sample of labelled rows (``per_class`` of each class, the first by a hash of the id). Labels
belong to documents, not windows, so each epoch takes from every document its highest window as the example, and for
clean documents a second random one. Word and character vectors start from the shrunken log-odds of the words and
n-grams in the sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.llm import blocks as B

WINDOW, STRIDE = 32, 24
D_WORD, D_CHAR, HIDDEN = 6, 6, 8
BUCKETS = 1 << 16
MAX_TRAIN_CHARS = 20_000
TOP, MIN_JOINT = 3, 400


# ---------------------------------------------------------------------------------------------- inputs
def _ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Bucket of each character 3-, 4- and 5-gram of each byte run, edges marked, and the run it belongs to."""
    n = ends - starts
    total = int((n + 2).sum())
    if not total:
        return np.zeros(0, np.uint16), np.zeros(0, np.int32)
    begin = np.concatenate([[0], np.cumsum(n + 2)])
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
    pos = (np.arange(total) - begin[owner]).astype(np.int32)
    buf = np.full(total, 1, np.uint64)  # the edge mark
    inner = (pos > 0) & (pos <= n[owner])
    buf[inner] = B._LOWER[data[(starts[owner] + pos - 1)[inner]]].astype(np.uint64)
    got, own = [], []
    code = buf.copy()
    for k in range(1, 5):
        code = code[:-1] * np.uint64(257) + buf[k:]
        if k >= 2:
            ok = pos[:len(code)] + k < (n + 2)[owner[:len(code)]]
            got.append((B.mix(code[ok] + np.uint64(k << 48)) % np.uint64(BUCKETS)).astype(np.uint16))
            own.append(owner[:len(code)][ok])
    return np.concatenate(got), np.concatenate(own)


class Words:
    """The words of a chunk: per word occurrence its distinct-word number and row, and the distinct words' inputs."""

    def __init__(self, data, offsets):
        parts = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
        for i, j in B.row_chunks(offsets):
            o = offsets[i]
            s, e, r = B.tokens(data[o:offsets[j]], offsets[i:j + 1] - o, B.IS_WORD)
            parts.append([s + o, e + o, r + i, B.token_hashes(data[o:offsets[j]], s, e, lower=True)])
        s, e, self.rows, h = (np.concatenate(p) for p in zip(*parts))
        self.hash, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.grams, self.owner = _ngrams(data, s[first], e[first])
        order = np.argsort(self.owner, kind="stable")
        self.grams, self.owner = self.grams[order], self.owner[order]
        self.n_rows = len(offsets) - 1

    def part(self, ids: np.ndarray) -> "Words":
        """Only the distinct words numbered ``ids`` (sorted), renumbered; without occurrences."""
        first = np.searchsorted(self.owner, ids)
        n = np.searchsorted(self.owner, ids, "right") - first
        out = object.__new__(Words)
        out.hash, out.owner = self.hash[ids], np.repeat(np.arange(len(ids), dtype=np.int32), n)
        out.grams = self.grams[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        return out

    def windows(self):
        """First word, length and row of every window; a row's windows cover all its words."""
        counts = np.bincount(self.rows, minlength=self.n_rows)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
        row = np.repeat(np.arange(self.n_rows), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin = first[row] + k * STRIDE
        return begin, np.minimum(WINDOW, first[row] + counts[row] - begin), row


# ---------------------------------------------------------------------------------------------- network
def _sig(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_model(vocab: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7) -> dict:
    """Initial weights; the first coordinate of the input vectors carries the log-odds."""
    g = np.random.default_rng(seed)
    f = lambda *shape: (g.standard_normal(shape) * 0.1).astype(np.float32)
    d = D_WORD + D_CHAR
    m = {"vocab": vocab, "word": f(len(vocab) + 1, D_WORD) * 0.1, "gram": f(BUCKETS, D_CHAR) * 0.1}
    m["word"][:-1, 0], m["gram"][:, 0] = word_odds, gram_odds
    m["word"][-1] = 0
    for k in "fb":
        m["W" + k], m["U" + k], m["c" + k] = f(d, 3 * HIDDEN), f(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
        m["W" + k][0, 2 * HIDDEN] = m["W" + k][D_WORD, 2 * HIDDEN] = 0.7
    m["att"], m["out"], m["bias"] = f(2 * HIDDEN), f(2 * HIDDEN), np.zeros(1, np.float32)
    m["att"][[0, HIDDEN]], m["out"][[0, HIDDEN]], m["bias"][0] = 1.0, 1.5, -1.0
    return m


def inputs(m: dict, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Input vectors of the distinct words, and their rows in the word table (the last: unknown)."""
    at = np.searchsorted(m["vocab"], w.hash)
    at = np.where((at < len(m["vocab"])) & (m["vocab"][np.minimum(at, len(m["vocab"]) - 1)] == w.hash), at,
                  len(m["vocab"])) if len(m["vocab"]) else np.zeros(len(w.hash), np.int64)
    x = np.empty((len(w.hash), D_WORD + D_CHAR), np.float32)
    x[:, :D_WORD] = m["word"][at]
    for i in range(0, len(w.hash), 1 << 16):  # blocks of words
        j = min(i + (1 << 16), len(w.hash))
        a, b = np.searchsorted(w.owner, [i, j])
        own, grams = w.owner[a:b] - i, w.grams[a:b]
        for k in range(D_CHAR):
            x[i:j, D_WORD + k] = np.bincount(own, weights=m["gram"][grams, k], minlength=j - i)
    return np.clip(x, -12, 12), at


def _pass(gates, U, idx, live, steps, keep):
    """One direction: hidden states [steps, windows, HIDDEN]; ``idx`` the distinct word and ``live`` 0/1 at each step."""
    H = HIDDEN
    h = np.zeros((idx.shape[1], H), np.float32)
    states, saved = np.empty((idx.shape[0], idx.shape[1], H), np.float32), []
    for t in steps:
        g, r = gates[idx[t]], h @ U
        zr = _sig(g[:, :2 * H] + r[:, :2 * H])
        z, q = zr[:, :H], zr[:, H:]
        n = np.tanh(g[:, 2 * H:] + q * r[:, 2 * H:])
        new = h + live[t][:, None] * (1 - z) * (n - h)
        if keep:
            saved.append((t, h, r[:, 2 * H:], z, q, n))
        h = new
        states[t] = h
    return states, saved


def forward(m: dict, x: np.ndarray, idx: np.ndarray, live: np.ndarray, keep: bool = False):
    """Logits of windows; ``idx`` and ``live`` are [WINDOW, windows]."""
    T = idx.shape[0]
    hf, sf = _pass(x @ m["Wf"] + m["cf"], m["Uf"], idx, live, range(T), keep)
    hb, sb = _pass(x @ m["Wb"] + m["cb"], m["Ub"], idx, live, range(T - 1, -1, -1), keep)
    H = HIDDEN
    a = hf @ m["att"][:H] + hb @ m["att"][H:]
    a = np.where(live > 0, a, -1e9)
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = np.concatenate([np.einsum("tb,tbh->bh", a, hf), np.einsum("tb,tbh->bh", a, hb)], 1)
    logit = pooled @ m["out"] + m["bias"][0]
    return logit, (hf, hb, sf, sb, a, pooled) if keep else None


def backward(m: dict, x, idx, live, saved, dlogit) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of the input vectors ``x``."""
    hf, hb, sf, sb, a, pooled = saved
    H, g, dx = HIDDEN, {}, np.zeros_like(x)
    g["out"], g["bias"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
    dp = dlogit[:, None] * m["out"]
    da = np.einsum("bh,tbh->tb", dp[:, :H], hf) + np.einsum("bh,tbh->tb", dp[:, H:], hb)
    da = a * (da - (a * da).sum(0))
    g["att"] = np.concatenate([np.einsum("tb,tbh->h", da, hf), np.einsum("tb,tbh->h", da, hb)])
    for k, steps, part, att in (("f", sf, dp[:, :H], m["att"][:H]), ("b", sb, dp[:, H:], m["att"][H:])):
        W, U = m["W" + k], m["U" + k]
        dW, dU, dc = np.zeros_like(W), np.zeros_like(U), np.zeros(3 * H, np.float32)
        dh = np.zeros((idx.shape[1], H), np.float32)
        for t, h0, rn, z, q, n in reversed(steps):
            dh = dh + a[t][:, None] * part + da[t][:, None] * att
            up = live[t][:, None] * dh
            dn = up * (1 - z) * (1 - n * n)
            dz = -up * (n - h0) * z * (1 - z)
            dq = dn * rn * q * (1 - q)
            dg = np.concatenate([dz, dq, dn], 1)
            dr = np.concatenate([dz, dq, dn * q], 1)
            dh = dh - up * (1 - z) + dr @ U.T
            dU += h0.T @ dr
            dW += x[idx[t]].T @ dg
            dc += dg.sum(0)
            dgx = dg @ W.T
            for c in range(x.shape[1]):
                dx[:, c] += np.bincount(idx[t], weights=dgx[:, c], minlength=len(x))
        g["W" + k], g["U" + k], g["c" + k] = dW, dU, dc
    return g, dx


def _grid(w: Words, begin, length):
    """[WINDOW, windows] distinct-word numbers and 0/1 marks of windows."""
    t = np.arange(WINDOW)[:, None]
    live = (t < length[None, :])
    at = np.minimum(begin[None, :] + t, len(w.ids) - 1)
    return w.ids[at], live.astype(np.float32)


def features(m: dict, w: Words, block: int = 4096) -> np.ndarray:
    """[rows, TOP + 2]: the highest window logits, downwards (-8 where there are fewer), log of the windows, and 1."""
    begin, length, row = w.windows()
    out = np.full((w.n_rows, TOP + 2), -8.0)
    out[:, TOP + 1] = 1
    out[:, TOP] = np.log1p(np.bincount(row, minlength=w.n_rows)) if len(row) else 0
    if len(begin):
        x, _ = inputs(m, w)
        logit = np.concatenate([forward(m, x, *_grid(w, begin[i:i + block], length[i:i + block]))[0]
                                for i in range(0, len(begin), block)])
        order = np.lexsort((-logit, row))
        row, logit = row[order], logit[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < TOP
        out[row[top], place[top]] = np.clip(logit[top], -8, 8)
    return out


def score_rows(m: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Score of each text; a text without words scores like one whose windows are all at the lowest."""
    z = features(m, Words(data, offsets)) @ m["joint"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _joint(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression (classes weigh the same, ridge), by Newton steps."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * 1.0
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + w)
    return w


# ---------------------------------------------------------------------------------------------- training
def _odds(with_: np.ndarray, without: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-odds of appearing in toxic over clean documents, pulled to 0 by two standard errors."""
    d = np.log((with_ + 0.5) / (n1 + 1)) - np.log((without + 0.5) / (n0 + 1))
    se = np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5))
    return (np.sign(d) * np.maximum(0, np.abs(d) - 2 * se)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, **options) -> dict | None:
    """A model fitted on the sample, or None where it lacks a class: the network, then the joint weights."""
    import pyarrow as pa

    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    g = np.random.default_rng(17)
    apart = np.zeros(len(y), bool)
    if len(y) >= MIN_JOINT:
        for c in (0, 1):
            at = np.flatnonzero(y == c)
            apart[g.permutation(at)[:len(at) // 4]] = True
    seen = np.flatnonzero(~apart)
    m = _network([texts[i] for i in seen], y[seen], **options)
    m["joint"] = np.array([1.0, *[0.0] * (TOP + 1)])
    held = np.flatnonzero(apart)
    if len(held) and 0 < y[held].sum() < len(held):
        w = Words(*B.utf8(pa.array([texts[i] for i in held], pa.string())))
        m["joint"] = _joint(features(m, w), y[held])
    return m


def _network(texts: list[str], y: np.ndarray, epochs: int = 6, batch: int = 512, rate: float = 0.01,
             min_docs: int = 3, steps: int = 150, seed: int = 7) -> dict:
    """Weights of the network; a small sample gets smaller batches and more epochs, ``steps`` steps at least."""
    import pyarrow as pa

    data, off = B.utf8(pa.array(texts, pa.string()))
    w = Words(data, off)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    # documents with each word / n-gram, by class
    seen = np.unique(w.rows * np.int64(len(w.hash)) + w.ids)
    cls, word = y[seen // len(w.hash)], seen % len(w.hash)
    a, b = np.bincount(word[cls == 1], minlength=len(w.hash)), np.bincount(word[cls == 0], minlength=len(w.hash))
    known = np.flatnonzero(a + b >= min_docs)
    first = np.searchsorted(w.owner, np.arange(len(w.hash) + 1))
    ga, gb = np.zeros(BUCKETS), np.zeros(BUCKETS)
    split = np.searchsorted(seen // len(w.hash), np.arange(len(y) + 1))
    for d in range(len(y)):
        ws = word[split[d]:split[d + 1]]
        lens = first[ws + 1] - first[ws]
        pick = np.repeat(first[ws] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        mark = np.zeros(BUCKETS, bool)
        mark[w.grams[pick]] = True
        (ga if y[d] else gb)[mark] += 1
    m = new_model(w.hash[known], _odds(a[known], b[known], n1, n0), _odds(ga, gb, n1, n0), seed)
    begin, length, row = w.windows()
    g = np.random.default_rng(seed)
    names = ["Wf", "Uf", "cf", "Wb", "Ub", "cb", "att", "out", "bias", "word", "gram"]
    mom, var, step = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}, 0
    batch = min(batch, max(32, len(y) // 8))
    for _ in range(max(epochs, -(-steps * batch // (2 * len(y))))):
        x, at = inputs(m, w)
        logit = np.concatenate([forward(m, x, *_grid(w, begin[i:i + 8192], length[i:i + 8192]))[0]
                                for i in range(0, len(begin), 8192)])
        order = np.lexsort((logit, row))
        top = order[np.append(row[order][1:] != row[order][:-1], True)]
        clean = np.flatnonzero(y[row] == 0)
        pick = np.concatenate([top, g.choice(clean, min(len(clean), n0))])
        g.shuffle(pick)
        for i in range(0, len(pick), batch):
            p = pick[i:i + batch]
            idx, live = _grid(w, begin[p], length[p])
            used, idx = np.unique(idx, return_inverse=True)
            own = w.part(used)
            x, at = inputs(m, own)
            z, saved = forward(m, x, idx, live, keep=True)
            t = y[row[p]].astype(np.float32)
            weight = np.where(t > 0, 0.5 / max(t.mean(), 0.02), 0.5 / max(1 - t.mean(), 0.02))
            dl = ((1 / (1 + np.exp(-z)) - t) * weight / len(p)).astype(np.float32)
            grad, dx = backward(m, x, idx, live, saved, dl)
            grad["word"], grad["gram"] = np.zeros_like(m["word"]), np.zeros_like(m["gram"])
            np.add.at(grad["word"], at, dx[:, :D_WORD])
            grad["word"][-1] = 0
            for k in range(D_CHAR):
                grad["gram"][:, k] = np.bincount(own.grams, weights=dx[own.owner, D_WORD + k], minlength=BUCKETS)
            step += 1
            for k in names:
                mom[k] = 0.9 * mom[k] + 0.1 * grad[k]
                var[k] = 0.99 * var[k] + 0.01 * grad[k] ** 2
                move = mom[k] / (1 - 0.9 ** step) / (np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-6)
                m[k] = (m[k] - rate * (0.1 if k in ("word", "gram") else 1) * move).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        learn=None, per_class: int = 2400) -> dict | None:
    """A model from labelled documents.

    ``learn`` filters the ids to learn from. The sample is bounded: at most ``per_class`` documents of each class, the
    first by a hash of their id, none over ``MAX_TRAIN_CHARS`` characters; rows with a null id, label or text and ids
    labelled both ways are left out. Without both classes the result is None and every text scores 0.
    """
    ids = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if learn is not None:
        ids = ids.where(learn(F.col("id")))
    ids = ids.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi")
    order = [F.xxhash64("id", F.lit(4)), F.col("id")]
    pick = ids.where("y = 0").orderBy(*order).limit(2 * per_class).unionAll(
        ids.where("y = 1").orderBy(*order).limit(2 * per_class)).select("id", "y")
    # at most 4 * per_class rows, so this side may be broadcast at any size of the corpus
    got = (docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
           .where(F.length("t").between(1, MAX_TRAIN_CHARS)).join(F.broadcast(pick), "id")
           .dropDuplicates(["id"]))
    got = got.where("y = 0").orderBy(*order).limit(per_class).unionAll(got.where("y = 1").orderBy(*order).limit(per_class))

    def run(batches):  # one task trains on the sample; the driver gets the weights
        import pickle

        import pyarrow as pa

        texts, y = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(y)))], pa.binary())], ["model"])

    import pickle

    row = got.repartition(1).sortWithinPartitions("y", *order).select("t", "y").mapInArrow(run, "model binary").collect()
    return pickle.loads(row[0]["model"]) if row else None


def score(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None,
          threshold: float = 0.7) -> DataFrame:
    """``docs`` (or its ``keep`` columns) plus ``score`` double and ``predicted`` int (1 from ``threshold`` on).

    Null and empty texts score like a text without words; input columns named ``score`` or ``predicted`` are replaced.
    An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(_, data, off):
            s = score_rows(m, data, off) if m is not None else np.zeros(len(off) - 1)
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}
        return f

    return B.append(docs, text, keep, "score double, predicted int", make)
