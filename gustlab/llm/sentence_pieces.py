"""SentencePiece (BPE) encoding that keeps offsets, and decoding.

A text is normalised through the model's compiled character map: at every position the longest key of the map that the
text goes on with is replaced, and every character of the result remembers the byte of the source it came from. The
normalised text is cut where no piece of the vocabulary can reach across, each part is merged by the scores of the
pieces, and a part that was met before is looked up. The begin and end of every piece are then read from the remembered
offsets, so each piece has its span of bytes of the original text.

The model file is read once, on the driver, and travels with the tasks (half a megabyte for 32,000 pieces).
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustlab.llm import blocks as B

SPACE = "▁"  # the visible space of normalised texts
HELD_CHARS = 1 << 22  # about 100 MB of parts
LONG_WORD = 48
ROWS = 256  # decoded at a time
# The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

_READY = B.Scratch()


def character_map(blob: bytes) -> dict[str, str]:
    """The keys and replacements of a compiled character map: a double-array trie, then the replacements it points to."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size:]
    label, shift = units & 0x800000FF, np.where(units & 0x200, 8, 0)
    child, leaf = (units >> 10) << shift, (units & 0x100) > 0
    out, todo, letters = {}, [(b"", int(child[0]))], np.arange(1, 256)
    while todo:
        key, node = todo.pop()
        at = node ^ letters
        hit = at < len(units)
        hit[hit] = label[at[hit]] == letters[hit]
        for c, k in zip(letters[hit].tolist(), at[hit].tolist()):
            to = k ^ int(child[k])
            if leaf[k]:
                start = int(units[to]) & 0x7FFFFFFF
                out[(key + bytes([c])).decode()] = texts[start:texts.index(b"\0", start)].decode()
            todo.append((key + bytes([c]), to))
    return out


class Normalizer:
    """Text to normalised text, with the source byte of every character (:meth:`__call__`)."""

    def __init__(self, spec, suffix: bool, symbols: list[str]):
        self.map = character_map(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape, self.suffix = (spec.add_dummy_prefix, spec.remove_extra_whitespaces,
                                                               spec.escape_whitespaces, suffix)
        for s in symbols:  # symbols of the user stand as they are
            self.map[s] = s
        self.symbols = set(symbols)
        self.longest: dict[str, int] = {}
        for k in self.map:
            self.longest[k[0]] = max(len(k), self.longest.get(k[0], 0))
        self.first = re.compile("[" + "".join(map(re.escape, self.longest)) + "]") if self.map else None

    def _key(self, text: str, i: int) -> str | None:
        """The longest key that stands at ``i``; a symbol of the user comes before any key."""
        n = min(self.longest[text[i]], len(text) - i)
        keys = [text[i:i + k] for k in range(n, 0, -1) if text[i:i + k] in self.map]
        return next((k for k in keys if k in self.symbols), keys[0] if keys else None)

    def _head(self, text: str) -> int:
        """How many characters at the begin of a text are each a space, or become one."""
        i = 0
        while i < len(text):
            key = (self._key(text, i) if text[i] in self.longest else None) or text[i]
            if self.map.get(key, key) != " ":
                break
            i += len(key)
        return i

    def _mapped(self, text: str, at: np.ndarray):
        """The text after the map, source bytes of its characters, and which of them stand inside a replacement."""
        outs, froms, inside, i, m = [], [], [], 0, self.first.search(text)
        while m:
            j = m.start()
            key = self._key(text, j)
            if key is None:
                m = self.first.search(text, j + 1)
                continue
            new = self.map[key]
            outs += [text[i:j], new]
            froms += [at[i:j], np.full(len(new), at[j])]
            inside += [np.zeros(j - i, bool), np.array([bool(new[:k].strip(" ")) for k in range(len(new))], bool)]
            i = j + len(key)
            m = self.first.search(text, i)
        if not outs:
            return text, at[:-1], np.zeros(len(text), bool)
        return "".join([*outs, text[i:]]), np.concatenate([*froms, at[i:-1]]), np.concatenate([*inside, np.zeros(len(text) - i, bool)])

    def __call__(self, text: str, raw: np.ndarray) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters (and its end) the offset in ``raw``, the text's bytes."""
        if not text:
            return "", np.zeros(1, np.int64)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        end, begin = len(raw), 0
        if self.squeeze:
            begin = int(at[self._head(text)])
            if begin == end:
                return "", np.array([end])
        if self.first:
            text, at, inside = self._mapped(text, at)
        else:
            at, inside = at[:-1], None
        if self.squeeze:
            space = np.array([c == " " for c in text], bool)
            drop = space & np.append(True, space)[:-1]
            if inside is not None:
                drop &= ~inside
            text, at = "".join([c for c, d in zip(text, drop.tolist()) if not d]), at[~drop]
        mark = SPACE if self.escape else " "
        if self.escape:
            text = text.replace(" ", SPACE)
        if self.prefix and not self.suffix:
            text, at = mark + text, np.append(begin, at)
        if self.squeeze:
            n = len(text.rstrip(mark))
            if n < len(text):
                end, text, at = int(at[n]), text[:n], at[:n]
        if self.prefix and self.suffix:
            text, at = text + mark, np.append(at, end)
        return text, np.append(at, end)


class Encoder:
    """Pieces of normalised texts by a BPE model, part by part; the parts met are kept up to ``HELD_CHARS`` characters."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        kinds = [p.type for p in m.pieces]
        if m.trainer_spec.model_type != BPE or UNUSED in kinds:
            raise ValueError("a BPE model without unused pieces is asked for")
        self.ids = {p.piece: i for i, p in enumerate(m.pieces)}
        self.cost = {p.piece: -p.score for p in m.pieces if p.type in (NORMAL, USER)}
        self.user = {p.piece for p in m.pieces if p.type == USER}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = [self.ids.get(f"<0x{i:02X}>", self.unknown) for i in range(256)] if m.trainer_spec.byte_fallback else None
        self.normalize = Normalizer(m.normalizer_spec, m.trainer_spec.treat_whitespace_as_suffix, sorted(self.user))
        # two characters can be in one piece only where some piece holds them next to each other
        self.pairs = {p[i:i + 2] for p in self.cost for i in range(len(p) - 1)}
        spaced = any(a != SPACE and b == SPACE for a, b in self.pairs) or any(SPACE in u for u in self.user)
        self.words = None if spaced else self._splitter().findall
        self.symbols = re.compile("|".join(map(re.escape, sorted(self.user, key=len, reverse=True)))) if self.user else None
        self.begin, self.end = m.trainer_spec.bos_id, m.trainer_spec.eos_id
        self.clear()

    def _splitter(self) -> re.Pattern:
        """Cuts before visible spaces, and between letters and the marks that no piece holds right after anything else
        than a mark or a visible space."""
        marks = {c for p in self.pairs for c in p if not c.isalpha()} - {SPACE} | {"\n"}
        while late := {p[1] for p in self.pairs if p[1] in marks and p[0] != SPACE and p[0] not in marks}:
            marks -= late
        m = re.escape("".join(sorted(marks)))
        return re.compile(f"{SPACE}*[^{SPACE}{m}]+|{SPACE}*[{m}]+[^{SPACE}{m}]*|{SPACE}+")

    def clear(self) -> None:
        """Forget the parts met; the begin and end id stay as parts 0 and 1."""
        self.found: dict[str, int] = {}
        self.flat_ids, self.flat_lens, self.offsets, self.held = array("i"), array("i"), array("q", [0]), 0
        for i in (self.begin, self.end):
            self._add([i] if i >= 0 else [], [0] if i >= 0 else [])

    def _add(self, ids: list[int], lens: list[int]) -> int:
        self.flat_ids.extend(ids)
        self.flat_lens.extend(lens)
        self.offsets.append(len(self.flat_ids))
        return len(self.offsets) - 2

    def merged(self, part: str) -> tuple[list[int], list[int]]:
        """Ids and lengths in characters of a part: of all neighbours that are a piece together the one of the best score, the
        leftmost of equals, is joined until there is none."""
        sym = self._join_few(part) if len(part) <= LONG_WORD else self._join_many(part)
        try:
            return [self.ids[s] for s in sym], [len(s) for s in sym]
        except KeyError:
            pass
        ids, lens = [], []
        for s in sym:
            i = self.ids.get(s)
            if i is None and self.bytes:
                raw = s.encode()
                ids += [self.bytes[b] for b in raw]
                lens += [0] * (len(raw) - 1) + [len(s)]
            else:
                ids.append(self.unknown if i is None else i)
                lens.append(len(s))
        return ids, lens

    def _join_few(self, part: str) -> list[str]:
        """By the smallest of a list of costs, one for each neighbouring pair."""
        sym, get, none = list(part), self.cost.get, float("inf")
        costs = [get(part[i:i + 2], none) for i in range(len(part) - 1)]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            sym[i:i + 2] = [sym[i] + sym[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = get(sym[i - 1] + sym[i], none)
            if i < len(costs):
                costs[i] = get(sym[i] + sym[i + 1], none)
        return sym

    def _join_many(self, part: str) -> list[str]:
        """By a heap of pairs, so that a long part takes little more than its length in steps."""
        sym, nxt, prv = list(part), list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        get = self.cost.get
        heap = [(c, i, 2) for i in range(len(part) - 1) if (c := get(part[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i, j):
            c = get(sym[i] + sym[j])
            if c is not None:
                heapq.heappush(heap, (c, i, len(sym[i]) + len(sym[j])))

        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i]
            if not sym[i] or j >= len(sym) or len(sym[i]) + len(sym[j]) != size:
                continue  # one of the two has been joined since
            sym[i], sym[j] = sym[i] + sym[j], ""
            k = nxt[i] = nxt[j]
            if k < len(sym):
                prv[k] = i
                offer(i, k)
            if prv[i] >= 0:
                offer(prv[i], i)
        return [s for s in sym if s]

    def _cuts(self, word: str) -> list[str]:
        pairs, cuts = self.pairs, [0]
        cuts += [i for i in range(1, len(word)) if word[i - 1:i + 1] not in pairs]
        return [word[i:j] for i, j in zip(cuts, [*cuts[1:], len(word)])]

    def _part(self, part: str) -> int:
        i = self.found.get(part)
        if i is None:
            i = self.found[part] = self._add(*self.merged(part))
            self.held += len(part)
        return i

    def _word(self, word: str, out: list[int]) -> None:
        out += [self._part(p) for p in (self._cuts(word) if len(word) > LONG_WORD else [word])]

    def parts(self, text: str) -> list[int]:
        """The parts of a normalised text, between begin and end."""
        out, get = [0], self.found.get
        free, symbols = [text], []
        if self.symbols:
            free, symbols = self.symbols.split(text), self.symbols.findall(text)
        for k, t in enumerate(free):
            for w in (self.words(t) if self.words else [t] if t else []):
                i = get(w)
                if i is None:
                    self._word(w, out)
                else:
                    out.append(i)
            if k < len(symbols):
                s = symbols[k]
                if s not in self.found:
                    self.found[s] = self._add([self.ids[s]], [len(s)])
                out.append(self.found[s])
        out.append(1)
        return out

    def encode(self, texts: list[str], raw: np.ndarray, off: np.ndarray):
        """Ids, begins and ends of the pieces of several texts (``raw``: their bytes), and the n + 1 offsets of the texts."""
        if self.held > HELD_CHARS:
            self.clear()
        parts, counts, sources = [], [], []
        for k, t in enumerate(texts):
            norm, at = self.normalize(t or "", raw[off[k]:off[k + 1]])
            p = self.parts(norm)
            parts += p
            counts.append(len(p))
            sources.append(at)
        parts, offsets = np.array(parts, np.int64), np.frombuffer(self.offsets, np.int64)
        size = offsets[parts + 1] - offsets[parts]
        upto = np.cumsum(size)
        pick = np.repeat(offsets[parts] - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)
        ids, lens = (np.frombuffer(x, np.int32)[pick] for x in (self.flat_ids, self.flat_lens))
        del offsets
        doc = np.repeat(np.arange(len(texts)), np.add.reduceat(size, np.cumsum([0, *counts[:-1]])) if len(texts) else [])
        if not self.bytes:  # neighbouring unknown characters are one unknown piece
            more = np.zeros(len(ids), bool)
            more[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (doc[1:] == doc[:-1])
            keep = np.flatnonzero(~more)
            lens, ids, doc = np.add.reduceat(lens, keep) if len(keep) else lens, ids[keep], doc[keep]
        end = np.cumsum(lens, dtype=np.int64)
        at = np.concatenate(sources) if sources else np.zeros(0, np.int64)
        return (ids.astype("<u4"), at[end - lens + doc].astype(np.int32), at[end + doc].astype(np.int32),
                np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))))


def read_model(path: str) -> bytes:
    """The bytes of a model file that the driver can read."""
    with open(path, "rb") as f:
        return f.read()


def _once(kind: str, model: bytes, make):
    """One encoder or decoder of a model in a worker process."""
    key = (kind, len(model), hash(model))
    if key not in _READY:
        _READY.clear()
        _READY[key] = make(model)
    return _READY[key]


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _decoded(sp, ids: np.ndarray) -> str:
    return sp.decode(ids.tolist())


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) plus the pieces of every whole text, as the library encodes it with begin and end ids:
    ``ids`` binary (unsigned 32-bit numbers, little endian), ``begins`` and ``ends`` array<int> (bytes of the original text
    that each piece stands for; none for the begin and end id, and all at the last of several byte pieces). A name in
    ``decoded`` adds the text that the library decodes from these ids, in the same task.

    A null text encodes as the empty one: begin and end id. Repeated rows keep a row each; an empty table gives an
    empty result; input columns named like the outputs are replaced. Texts come in blocks of about a megabyte, a longer
    one alone.
    """
    def make():
        enc, sp = _once("both" if decoded else "encode", model, lambda m: (Encoder(m), _processor(m) if decoded else None))

        def f(texts, raw, off):
            ids, begins, ends, at = enc.encode(texts.to_pylist(), raw, off)
            place = pa.array(at.astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids)])
            out = {"ids": packed, "begins": pa.ListArray.from_arrays(place, pa.array(begins)),
                   "ends": pa.ListArray.from_arrays(place, pa.array(ends))}
            if decoded:
                out[decoded] = pa.array([_decoded(sp, ids[i:j]) for i, j in zip(at[:-1], at[1:])], pa.string())
            return out
        return f

    return B.append(docs, text, keep, "ids binary, begins array<int>, ends array<int>" + (f", {decoded} string" if decoded else ""), make)


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus the text that the library decodes from the packed ids of each row (null ids: null); a column of the
    output's name is replaced."""
    kept = B.without(df, [out])
    names = kept.columns
    src = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").alias("__ids"))

    def run(batches):
        sp = _once("decode", model, _processor)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                texts = [None if x is None else _decoded(sp, np.frombuffer(x, "<u4")) for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*names, out])

    return src.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))
