"""Token counts by a separator scan over flat token files.

A flat token file is nothing but token ids, two bytes each (little endian), with an end-of-document id after each
document: no index, no lengths. It is read in blocks of a fixed size, by any task in any order. A vectorised search finds
the end ids of a block, which cut it into pieces; a prefix scan of the blocks' numbers of ends gives the ordinal of
the document that each piece belongs to, and the pieces of a document that lies across blocks add up.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustlab.llm import blocks as B
from gustlab.llm.files import fresh_name, open_folder
from gustlab.session import cut_lineage, scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 25


def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file (base64 token and rank a line); its ids stay below ``END_ID``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= END_ID:
        raise ValueError("the vocabulary reaches the end-of-document id")
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                 file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Tokenise every text (null: empty) into flat token files under ``folder``; returns the manifest, checkpointed: file,
    ordinal of the document in it from 0, and the id. A task writes its files one after the other, a new one after
    ``file_tokens`` tokens; names of lost attempts never reach the manifest."""
    src = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        enc, out, name, ordinal, size = encoder(vocabulary), None, None, 0, 0
        try:
            for b in batches:
                _, off = B.utf8(b.column(1))
                for i, j in B.row_chunks(off):
                    if out is None or size >= file_tokens:
                        if out is not None:
                            out.close()
                        name, ordinal, size = fresh_name("tokens", ".u16"), 0, 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    ids: list[int] = []
                    for t in b.column(1).slice(i, j - i).to_pylist():
                        ids += enc.encode_ordinary(t or "")
                        ids.append(END_ID)
                    raw = np.array(ids, "<u2")
                    out.write(raw.tobytes())
                    size += len(raw)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (j - i)), pa.array(np.arange(ordinal, ordinal + j - i)), b.column(0).slice(i, j - i)],
                        ["file", "ordinal", "id"])
                    ordinal += j - i
        finally:
            if out is not None:
                out.close()

    return cut_lineage(src.mapInArrow(run, f"file string, ordinal bigint, id {id_type}"))


def scan(spark: SparkSession, folder: str, files: DataFrame, block_tokens: int = BLOCK_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the flat token files named in column ``file`` of ``files``.

    Tokens after a file's last end id are a document without an end. An empty file has no document.
    """
    def cut(batches):
        fs, root = open_folder(folder)
        for b in batches:
            names = b.column(0).to_pylist()
            for name in names:
                n = fs.get_file_info(f"{root}/{name}").size // 2
                k = np.arange(-(-n // block_tokens))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(np.full(len(k), n))],
                                                 ["file", "block", "tokens"])

    def search(batches):
        fs, root = open_folder(folder)
        for b in batches:
            for name, k, n in zip(*[c.to_pylist() for c in b.columns]):
                with fs.open_input_file(f"{root}/{name}") as f:
                    size = min(block_tokens, n - k * block_tokens)
                    ids = np.frombuffer(f.read_at(2 * size, 2 * k * block_tokens), "<u2")
                ends = np.flatnonzero(ids == end_id)
                edge = np.concatenate([[-1], ends, [len(ids)]])
                pieces = np.diff(edge) - 1  # tokens between ends, the ends themselves left out
                m = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * m), pa.array(np.full(m, k)), pa.array(np.arange(m)), pa.array(pieces),
                     pa.array(np.arange(m) < m - 1)], ["file", "block", "piece", "tokens", "ended"])

    spread = spark.sparkContext.defaultParallelism * 4
    blocks = files.select("file").distinct().mapInArrow(cut, "file string, block bigint, tokens bigint").repartition(
        spread, "file", "block")
    pieces = cut_lineage(blocks.mapInArrow(search, "file string, block bigint, piece bigint, tokens bigint, ended boolean"))
    # the prefix scan: ends before each block of its file (a file has FILE_TOKENS / BLOCK_TOKENS blocks and a few)
    ends = pieces.groupBy("file", "block").agg(F.sum(F.col("ended").cast("long")).alias("ends"))
    before = F.sum("ends").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    scanned = ends.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return (pieces.join(scanned, ["file", "block"]).groupBy("file", (F.col("before") + F.col("piece")).alias("ordinal"))
            .agg(F.sum("tokens").alias("n_tokens"), F.max("ended").alias("ended"))
            .where("ended or n_tokens > 0").select("file", "ordinal", "n_tokens"))


def count_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                 block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """One row a row of ``docs``: the id and ``n_tokens`` long, counted by writing flat token files to the shared folder and
    scanning them. Null and empty texts have 0 tokens; repeated rows and null ids keep a row each; an empty table gives
    an empty result."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(docs, folder, id, text, vocabulary, file_tokens)
    found = scan(spark, folder, manifest, block_tokens)
    return manifest.join(found, ["file", "ordinal"], "left").select(F.col("id").alias(id),
                                                                     F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
