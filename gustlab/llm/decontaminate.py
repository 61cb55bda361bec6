"""Benchmark decontamination: BM25 inverted index of the test items, searched with block-max WAND.

Every document is cut into overlapping passages, and every passage is a query against the index: retrieved are all
items whose BM25 score is at least ``min_score`` of the score the item gives itself. A passage whose sum of its
words' highest possible contributions stays below that is dropped at once (vectorised); the rest go through
block-max WAND. A retrieved item counts as leaked when

- the passage holds at least ``min_overlap`` of its five-word shingles, or a run of the passage's words becomes the item
  by changing, dropping and adding at most ``1 - min_overlap`` of its words, so that an edit inside a short copy does not
  clear it; and
- of its question and of its answer at least ``min_part`` of the words stand there in their order. The benchmark has no
  answer column: the last fifth of an item's words (5 at least) stands for it, the rest is the question; an item under
  10 words is all question.

An item under five words must stand there as it is. An index holds at most about ``max_index_bytes`` of item text; a
larger benchmark is dealt to several, each searched in a pass of its own, so one index at a time is broadcast. The number
of items, the items a word stands in, the mean length and the longest item are those of the whole benchmark in each of
them: the results do not depend on the number of indexes.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustlab.llm import blocks as B
from gustlab.session import cut_lineage

K1, K2, POSTINGS_BLOCK, SHINGLE, BLOCKS = 1.2, 0.75, 16, 5, 64


def _contains(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _in_order(words: np.ndarray, part: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit a word of ``part`` (Hyyrö's recurrence)."""
    at: dict[int, int] = {}
    for j, w in enumerate(part.tolist()):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(part)) - 1
    left = full
    for w in words[np.isin(words, part)].tolist():
        use = left & at[w]
        left = (left + use | left - use) & full
    return len(part) - left.bit_count()


def _nearest(words: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Fewest changed, dropped and added words that make a run of ``words`` the item, and the place after the run's last
    word (the first such run); a bit a word of the item (Myers' recurrence)."""
    at: dict[int, int] = {}
    for j, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << j
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, cost = full, 0, len(item)
    best = (cost, 0)
    for j, w in enumerate(words.tolist()):
        same = at.get(w, 0)
        diagonal = same | down
        across = ((same & up) + up ^ up | same) & full
        more, less = down | full & ~(across | up), up & across
        cost += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | full & ~(diagonal | more), more & diagonal
        if cost < best[0]:
            best = (cost, j + 1)
    return best


class Figures(NamedTuple):
    """What an index must know of the whole benchmark: items, their mean number of words, the longest one's words, and
    for ascending terms the number of items that hold each."""
    n: int
    mean: float
    width: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Inverted index: per term its postings (item numbers, BM25 shares of the item's own score) in blocks, each with its
    highest share. Texts come lower-cased. Items without words are never found. Without ``figures`` the items are the
    whole benchmark."""

    def __init__(self, ids: list, texts: list[str], min_score: float = 0.6, figures: Figures | None = None):
        self.ids, self.min_score = list(ids), min_score
        data, off = B.utf8(pa.array(texts, pa.string()))
        s, e, row = B.tokens(data, off, B.IS_WORD)
        h, n = B.token_hashes(data, s, e), len(texts)
        self.n_words = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
        self.terms, term = np.unique(h, return_inverse=True)
        pair, tf = np.unique(term * np.int64(max(n, 1)) + row, return_counts=True)
        t, item = pair // max(n, 1), pair % max(n, 1)
        if figures is None:
            figures = Figures(n, float(self.n_words.mean()) if n else 1.0, int(self.n_words.max()) if n else 1, self.terms,
                              np.bincount(t, minlength=len(self.terms)))
        df = figures.df[np.searchsorted(figures.terms, self.terms)]
        idf = np.log1p((figures.n - df + 0.5) / (df + 0.5))
        mean = max(figures.mean, 1e-9)
        impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - K2 + K2 * self.n_words[item] / mean))
        own = np.bincount(item, weights=impact, minlength=n)
        share = impact / own[item]
        self.start = np.searchsorted(t, np.arange(len(self.terms) + 1))
        self.item, self.share = item, share
        self.top = np.maximum.reduceat(share, self.start[:-1]) if len(share) else np.zeros(0)
        # the highest share of each term in each of at most BLOCKS ranges of items
        self.span = max(1, -(-n // BLOCKS))
        key = t * np.int64(BLOCKS) + item // self.span
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.range_top = np.maximum.reduceat(share, at) if len(at) else np.zeros(0)
        self.range_no = key[at] % BLOCKS
        self.range_start = np.searchsorted(key[at] // BLOCKS, np.arange(len(self.terms) + 1))
        # blocks of postings within each term
        self.blocks = [(np.arange(a, b, POSTINGS_BLOCK)) for a, b in zip(self.start[:-1], self.start[1:])]
        self.block_last = [item[np.minimum(x + POSTINGS_BLOCK, b) - 1] for x, b in zip(self.blocks, self.start[1:])]
        self.block_top = [np.array([share[i:min(i + POSTINGS_BLOCK, b)].max() for i in x])
                          for x, b in zip(self.blocks, self.start[1:])]
        self.width = max(figures.width, 1)
        # words and shingles of whole items, words of questions and of answers
        bounds = np.searchsorted(row, np.arange(n + 1)) if len(row) else np.zeros(n + 1, np.int64)
        words = [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        cut = lambda k: k - max(5, k // 5) if k >= 10 else k
        self.whole = [np.unique(B.shingles(w, np.zeros(len(w), np.int64), 1, SHINGLE)[0]) for w in words]
        self.words = words
        self.question, self.answer = [w[:cut(len(w))] for w in words], [w[cut(len(w)):] for w in words]

    def _survivors(self, passage: np.ndarray, term: np.ndarray, batch: int = 1 << 19):
        """(passage, range of items) whose sum of the terms' highest shares in the range reaches ``min_score``."""
        n = self.range_start[term + 1] - self.range_start[term]
        total = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < len(term):
            j = max(int(np.searchsorted(total, total[i] + batch, "right")) - 1, i + 1)
            j = int(np.searchsorted(passage, passage[j - 1], "right"))  # whole passages
            m = n[i:j]
            at = np.repeat(self.range_start[term[i:j]] - (total[i:j] - total[i]), m) + np.arange(int(m.sum()))
            to = np.repeat(passage[i:j] - passage[i], m) * BLOCKS + self.range_no[at]
            bound = np.bincount(to, weights=self.range_top[at])
            for x in np.flatnonzero(bound >= self.min_score - 1e-9):
                yield int(x // BLOCKS + passage[i]), int(x % BLOCKS)
            i = j

    def search(self, terms: list[int], lo: int = 0, hi: int | None = None) -> list[tuple[int, float]]:
        """Items from ``lo`` to before ``hi`` that score at least ``min_score`` for distinct terms (numbers in the index)."""
        need = self.min_score - 1e-9
        cur, out = [], []
        for t in terms:
            a, b = self.start[t], self.start[t + 1]
            at = a + int(np.searchsorted(self.item[a:b], lo))
            if at < b and (hi is None or self.item[at] < hi):
                cur.append([int(self.item[at]), int(at), t, 0])
        while cur:
            cur.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cur):
                total += self.top[c[2]]
                if total >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cur[pivot][0]
            if hi is not None and item >= hi:
                break
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == item:
                pivot += 1
            # the blocks that would hold the pivot item bound the score more tightly
            bound, leave = 0.0, None
            for c in cur[:pivot + 1]:
                last = self.block_last[c[2]]
                while c[3] < len(last) and last[c[3]] < item:
                    c[3] += 1
                if c[3] < len(last):
                    bound += self.block_top[c[2]][c[3]]
                    leave = last[c[3]] if leave is None else min(leave, last[c[3]])
            if bound >= need:
                if cur[0][0] == item:
                    score = math.fsum(self.share[c[1]] for c in cur[:pivot + 1])  # the same in any order
                    if score >= need:
                        out.append((item, float(score)))
                to = item + 1
                if cur[0][0] < item:
                    to = item
            else:
                to = max(int(leave) if leave is not None else item, item) + 1
                if pivot + 1 < len(cur):
                    to = max(min(to, cur[pivot + 1][0]), item + 1)
            kept = []
            for k, c in enumerate(cur):
                if k <= pivot and c[0] < to:
                    end = self.start[c[2] + 1]
                    c[1] += int(np.searchsorted(self.item[c[1]:end], to))
                    if c[1] >= end:
                        continue
                    c[0] = int(self.item[c[1]])
                kept.append(c)
            cur = kept
        return out

    def passages(self, data: np.ndarray, off: np.ndarray, width: int):
        """(row, item, score, first word, words) of every item retrieved by a passage of ``2 * width`` words; passages
        start every ``width`` words, so any run of ``width`` words lies whole in one."""
        s, e, row = B.tokens(data, off, B.IS_WORD)
        h, n = B.token_hashes(data, s, e), len(off) - 1
        if not len(h) or not len(self.terms):
            return h, row, []
        count = np.bincount(row, minlength=n)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        hit = np.flatnonzero(_contains(self.terms, h))
        term = np.searchsorted(self.terms, h[hit])
        slot = (np.arange(len(h)) - first[row])[hit] // width
        slots = np.maximum(1, -(-count // width))  # passage k covers slots k and k + 1
        base = np.concatenate([[0], np.cumsum(slots)[:-1]])
        here = base[row[hit]] + slot
        V = np.int64(len(self.terms))
        pair = np.unique(np.concatenate([here * V + term, (here - 1)[slot > 0] * V + term[slot > 0]]))
        passage, term = pair // V, pair % V
        owner = np.repeat(np.arange(n), slots)
        found = []
        for p, block in self._survivors(passage, term):
            a, b = np.searchsorted(passage, [p, p + 1])
            for item, score in self.search(term[a:b].tolist(), block * self.span, (block + 1) * self.span):
                r = owner[p]
                begin = first[r] + (p - base[r]) * width
                found.append((int(r), item, score, int(begin), int(min(2 * width, first[r] + count[r] - begin))))
        return h, row, found

    def leaks(self, data: np.ndarray, off: np.ndarray, width: int, min_overlap: float, min_part: float):
        """{row: {item number: highest score}} of the verified items."""
        h, _, found = self.passages(data, off, width)
        out: dict[int, dict[int, float]] = {}
        for r, item, score, begin, size in found:
            if self._holds(h[begin:begin + size], item, min_overlap, min_part):
                d = out.setdefault(r, {})
                d[item] = max(score, d.get(item, 0.0))
        return out

    def _holds(self, words: np.ndarray, item: int, min_overlap: float, min_part: float) -> bool:
        k = int(self.n_words[item])
        if k < SHINGLE:  # shorter than a shingle: its words in order
            return self._run(words, item)
        both = lambda w: all(_in_order(w, x) >= min_part * len(x) for x in (self.question[item], self.answer[item]))
        have, _ = B.shingles(words, np.zeros(len(words), np.int64), 1, SHINGLE)
        if _contains(np.unique(have), self.whole[item]).mean() >= min_overlap and both(words):
            return True
        edits, end = _nearest(words, self.words[item])
        return edits <= (1 - min_overlap) * k + 1e-9 and both(words[max(0, end - k - edits):end])

    def _run(self, words: np.ndarray, item: int) -> bool:
        k = int(self.n_words[item])
        if len(words) < k:
            return False
        at = np.arange(len(words) - k + 1)
        flat = words[at[:, None] + np.arange(k)].ravel()
        sh, _ = B.shingles(flat, np.repeat(np.arange(len(at)), k), len(at), SHINGLE)
        return bool(np.isin(self.whole[item], sh).all())


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
             item_id: str = "item_id", item_text: str = "text", min_score: float = 0.6, min_overlap: float = 0.8,
             min_part: float = 0.5, max_index_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` (or its ``keep`` columns) plus ``contaminated`` boolean, ``item_ids`` array<bigint> (sorted, distinct) and
    ``best_score`` double (highest BM25 share of a leaked item, null if none).

    Null and empty texts are clean. Items with a null id or without words are left out; rows of the benchmark equal in id
    and text count once; equal texts under several ids are all reported; an empty benchmark leaves every document clean.
    Input columns named like the outputs are replaced.
    """
    items = benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.lower(F.coalesce(F.col(item_text).cast("string"), F.lit(""))).alias("t"))
    items = items.where("id is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    shards = max(1, -(-int(size) // max_index_bytes))
    out = docs.select("*" if keep is None else F.col(f"`{text}`").alias("__t"), *([F.col(f"`{text}`").alias("__t")] if keep is None else
                      [F.col(f"`{c}`") for c in keep])).withColumn("__low", F.lower("__t"))
    names = [c for c in out.columns if c not in ("__t", "__low")]
    kept = [c for c in names if c.lower() not in ("contaminated", "item_ids", "best_score")]
    sc, found = docs.sparkSession.sparkContext, "__ids array<bigint>, __best double"
    if shards == 1:
        rows = items.orderBy("id", "t").collect()  # bounded by max_index_bytes
        shared = sc.broadcast(Index([r["id"] for r in rows], [r["t"] for r in rows], min_score))
        got = B.append(out, "__low", names, found, _searcher(shared, min_overlap, min_part))
    else:
        # rows are numbered once; each pass leaves only the rows it found something in
        base = cut_lineage(out.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), "__low", F.monotonically_increasing_id().alias("__no")))
        hits = None
        for ids, texts, figures in _dealt(items, shards):
            shared = sc.broadcast(Index(ids, texts, min_score, figures))
            step = cut_lineage(B.append(base, "__low", ["__no"], found, _searcher(shared, min_overlap, min_part)).where(F.size("__ids") > 0))
            shared.unpersist()
            hits = step if hits is None else hits.unionAll(step)
        hits = hits.groupBy("__no").agg(F.flatten(F.collect_list("__ids")).alias("__ids"), F.max("__best").alias("__best"))
        got = base.join(hits, "__no", "left").select("__row.*", F.coalesce("__ids", F.array().cast("array<bigint>")).alias("__ids"), "__best")
    ids = F.array_sort(F.array_distinct("__ids"))
    return got.select(*[F.col(f"`{c}`") for c in kept], (F.size(ids) > 0).alias("contaminated"), ids.alias("item_ids"),
                      F.col("__best").alias("best_score"))


def _dealt(items: DataFrame, shards: int):
    """(ids, texts, figures) of each shard of the items, one at a time; the figures hold the shard's terms only."""
    items = cut_lineage(items.withColumn("shard", F.pmod(F.xxhash64("id", "t"), F.lit(shards)).cast("int")))

    def terms(batches):
        for b in batches:
            data, off = B.utf8(b.column(1))
            s, e, row = B.tokens(data, off, B.IS_WORD)
            h = B.token_hashes(data, s, e)
            at = np.unique(np.rec.fromarrays([row, h])) if len(h) else np.rec.fromarrays([row, h])
            shard = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard[at.f0], pa.int32()), pa.array(at.f1.astype(np.uint64).view(np.int64))], ["shard", "term"])

    def lengths(batches):
        for b in batches:
            data, off = B.utf8(b.column(0))
            row = B.tokens(data, off, B.IS_WORD)[2]
            yield pa.RecordBatch.from_arrays([pa.array(np.bincount(row, minlength=b.num_rows).astype(np.int64))], ["k"])

    n, words, width = items.select("t").mapInArrow(lengths, "k bigint").agg(F.count("*"), F.sum("k"), F.max("k")).first()
    by_shard = items.select("shard", "t").mapInArrow(terms, "shard int, term bigint").groupBy("term", "shard").agg(F.count("*").alias("n"))
    everywhere = by_shard.groupBy("term").agg(F.sum("n").alias("df"))
    held = cut_lineage(by_shard.join(everywhere, "term").select("shard", "term", "df"))
    for k in range(shards):
        rows = items.where(F.col("shard") == k).select("id", "t").orderBy("id", "t").collect()  # about max_index_bytes
        if rows:
            t = held.where(F.col("shard") == k).select("term", "df").toArrow()
            term = t.column("term").to_numpy().view(np.uint64)
            order = np.argsort(term)
            yield [r["id"] for r in rows], [r["t"] for r in rows], Figures(
                int(n), words / n, int(width), term[order], t.column("df").to_numpy()[order])


def _searcher(shared, min_overlap, min_part):
    def make():
        index = shared.value
        width = max(16, index.width)

        def f(_, data, off):
            got = index.leaks(data, off, width, min_overlap, min_part)
            n = len(off) - 1
            ids = [sorted({index.ids[i] for i in got[r]}) if r in got else [] for r in range(n)]
            best = [max(got[r].values()) if r in got else None for r in range(n)]
            return {"__ids": pa.array(ids, pa.list_(pa.int64())), "__best": pa.array(best, pa.float64())}
        return f
    return make
