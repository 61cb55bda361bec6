"""The backoff automaton against a plain reading in Python."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from gustlab.llm import lm
from gustlab.llm.queries import op7_backoff_automaton, remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return WORD.findall(low) + [None]


def brute(rows, learn, order, K):
    grams, N, texts = {}, 0, 0
    for i, t in rows:
        if learn(i):
            w = ["<b>", *toks(t)]
            texts += 1
            N += len(w) - 1
            for k in range(1, order + 1):
                for a in range(len(w) - k + 1):
                    if k > 1 or a > 0:
                        grams[tuple(w[a:a + k])] = grams.get(tuple(w[a:a + k]), 0) + 1
    grams[("<b>",)] = texts
    V = sum(1 for g in grams if len(g) == 1) - 1

    def p(w, h):
        if not h:
            return (grams.get((w,), 0) + 1) / (N + V + 1)
        low, c = p(w, h[1:]), grams.get(tuple(h), 0)
        return (grams.get((*h, w), 0) + K * low) / (c + K) if c else low

    out = []
    for i, t in rows:
        w, base, got, known = ["<b>", *toks(t)], 0.0, 0.0, 0
        for a in range(1, len(w)):
            base += math.log10(p(w[a], []))
            got += math.log10(p(w[a], w[max(0, a - order + 1):a]))
            known += (w[a],) in grams
        out.append((i, not learn(i), len(w) - 1, known, N, round(base, 6), round(got, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order, segment", [(1, 1024), (2, 1024), (3, 5), (3, 1024), (4, 7)])
def test_scores_equal_brute_force(spark, monkeypatch, order, segment):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 300)
    monkeypatch.setattr(lm, "SEGMENT", segment)
    g = random.Random(2)
    vocab = ["The", "the", "cat", "ÉTÉ", "été", "a,b", "x y", "dog", "z"]
    rows = [(i, g.choice([" ", "\t", "\x0b\n"]).join(g.choice(vocab) for _ in range(g.randint(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "  "), (203, "new words only"), (3, rows[3][1]), (None, "the cat"), (None, None)]
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.score(df, learn=lambda c: remainder(c, 7) != 2, order=order, concentration=5.0).collect()
    got = sorted([(*r[:5], round(r[5], 6), round(r[6], 6)) for r in got], key=str)
    assert got == brute(rows, learn, order, 5.0)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(df, learn=lambda c: c < 0).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 3, 0, 0, 0.0, 0.0)
    assert lm.score(df.limit(0)).collect() == []


def test_query_keeps_the_token_two_before(spark, tmp_path):
    """After "x m" comes "p", after "y m" comes "q"; the token before alone cannot tell."""
    rows = [(i, "x m p" if i % 2 else "y m q") for i in range(400)]
    rows += [(i, "x m p" if i % 2 else "x m q") for i in range(400, 800)]
    df = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2 and r[0] < 400]
                               + [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 2 and r[0] >= 400], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op7_backoff_automaton(spark, str(tmp_path)).collect() if r["held_out"]}
    seen, mixed = [[r["score"] for i, r in got.items() if i % 2 == k] for k in (1, 0)]
    assert min(seen) > max(mixed) + 0.5


def test_packed_keys_and_counts():
    g = np.random.default_rng(1)
    for width in (5, 7, 8):
        keys = np.unique(g.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) & np.uint64((1 << 8 * width) - 1))
        assert (lm._unpack(lm._pack(keys, width), len(keys), width) == keys).all()
        parts = lm._asking_order(keys, 7, width)
        assert [p for p, _ in parts] == list(range(7)) and (np.concatenate([keys[at] for _, at in parts]) == keys).all()
    c = g.choice([0, 1, 254, 255, 256, 1 << 40], 3000)
    assert (lm._unpack_counts(*lm._pack_counts(c), len(c)) == c).all()


def automaton(texts, new, order=3, K=5.0):
    """One bucket of texts to learn from and of a text ``new`` to read only."""
    import pyarrow as pa

    h, n = lm.token_stream(pa.array([*texts, new], pa.string()))
    learned = np.arange(len(h)) < len(h) - n[-1]
    return lm.Automaton(h, n, learned, order, {}, 1, 8, int(learned.sum()), len(np.unique(h[learned])), len(texts), [K] * (order - 1))


def test_states_and_arcs():
    a = automaton(["a b a b c", "b c", "", "a b d"], "zz")
    tokens = a.tokens
    source = a.arc // tokens
    assert (np.diff(a.arc) > 0).all() and a.fail[0] == 0 and (a.fail[1:] < np.arange(1, len(a.fail))).all()
    # each state's arcs and its failure arc share out all probability: known tokens and the unknown one, "zz"
    for s in range(len(a.fail)):
        assert sum(float(a._step(np.array([s]), np.array([t]))[0][0]) for t in range(tokens)) == pytest.approx(1.0)
    # a state is the longest context seen: after "a b" as after "b a b", and no state outlives an unknown token
    state = np.array([1])
    word = {t: int(a.token[i]) for t, i in (("a", 0), ("b", 1), ("c", 4))}
    ab = a._step(a._step(state, np.array([word["a"]]))[1], np.array([word["b"]]))[1]
    bab = ab
    for w in "ab":
        bab = a._step(bab, np.array([word[w]]))[1]
    assert bab[0] == ab[0] and a.fail[ab[0]] not in (0, 1)  # "a b" both times, which fails to "b"
    assert a._step(ab, a.token[-2:-1])[1][0] == 0
    assert set(np.unique(source)) <= set(range(len(a.fail)))


def test_very_long_text(spark):
    g = random.Random(4)
    long = " ".join(f"w{min(int(g.paretovariate(0.6)), 5000)}" for _ in range(120_000))
    rows = [(1, long), (2, "w1 w2"), (3, long[: len(long) // 2])]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), learn=lambda c: c != 2, concentration=5.0).collect()
    got = sorted([(*r[:5], round(r[5], 4), round(r[6], 4)) for r in got], key=str)
    assert got == [(*r[:5], round(r[5], 4), round(r[6], 4)) for r in brute(rows, lambda i: i != 2, 3, 5.0)]
