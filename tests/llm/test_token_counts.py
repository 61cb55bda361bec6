"""Token counts against the tokenizer itself, over blocks that cut documents."""

import random

import numpy as np
import pytest

from gustlab.llm import token_counts as T


@pytest.mark.parametrize("block,file_tokens", [(7, 50), (64, 1 << 25), (1 << 20, 1)])
def test_counts_equal_the_tokenizer(spark, block, file_tokens, monkeypatch):
    from gustlab.llm import blocks as B

    monkeypatch.setattr(B, "CHUNK_BYTES", 200)
    g = random.Random(4)
    rows = [(i, " ".join(g.choice(["cat", "été", "日本", "<|endoftext|>", "\n", "x1!"]) for _ in range(g.choice([0, 1, 5, 40])))) for i in range(90)]
    rows += [(200, None), (201, ""), (None, "a b"), (None, "a b"), (3, rows[3][1]), (300, "word " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    enc = T.encoder()
    want = sorted([(i, len(enc.encode_ordinary(t or ""))) for i, t in rows], key=str)
    got = T.count_tokens(df, block_tokens=block, file_tokens=file_tokens)
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert T.count_tokens(df.limit(0)).collect() == []


def test_scan_of_plain_files(spark, tmp_path):
    E = T.END_ID
    files = {"a": [1, 2, E, E, 3, E], "b": [], "c": [E], "d": [5, 6, 7], "e": [1] * 20 + [E] + [2] * 5}
    for k, ids in files.items():
        (tmp_path / k).write_bytes(np.array(ids, "<u2").tobytes())
    df = spark.createDataFrame([(k,) for k in files], "file string")
    got = sorted(map(tuple, T.scan(spark, str(tmp_path), df, block_tokens=4).collect()))
    assert got == [("a", 0, 2), ("a", 1, 0), ("a", 2, 1), ("c", 0, 0), ("d", 0, 3), ("e", 0, 20), ("e", 1, 5)]
