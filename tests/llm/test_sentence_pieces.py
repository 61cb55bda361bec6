"""SentencePiece pieces, spans and decoded texts against the library, also under other character maps and settings."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from gustlab.llm import sentence_pieces as S

MODEL = S.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def variant(rule=None, fallback=True, user=(), suffix=False, **spec):
    """The model with one of the library's own character maps, other settings of the normaliser, or more symbols."""
    m = pb.ModelProto()
    m.ParseFromString(MODEL)
    if rule:
        n = pb.ModelProto()
        n.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        m.normalizer_spec.precompiled_charsmap = n.normalizer_spec.precompiled_charsmap
    for k, v in spec.items():
        setattr(m.normalizer_spec, k, v)
    m.trainer_spec.byte_fallback, m.trainer_spec.treat_whitespace_as_suffix = fallback, suffix
    for p in m.pieces:
        if p.type == S.BYTE and not fallback:
            p.type = S.CONTROL
    for u in user:
        p = m.pieces.add()
        p.piece, p.score, p.type = u, 0.0, S.USER
    return m.SerializeToString()


MODELS = {
    "given": MODEL,
    "compatibility map, spaces squeezed": variant("nmt_nfkc", remove_extra_whitespaces=True),
    "case folded": variant("nmt_nfkc_cf"),
    "no byte pieces": variant(fallback=False),
    "no byte pieces, no prefix": variant("nfkc", fallback=False, remove_extra_whitespaces=True, add_dummy_prefix=False),
    "symbols of the user": variant("nmt_nfkc", user=["<s>x", "日本", "e r", "ab b "], remove_extra_whitespaces=True),
    "plain spaces": variant(escape_whitespaces=False),
    "space at the end": variant("nmt_nfkc", suffix=True, remove_extra_whitespaces=True),
}
LETTERS = [*"ab The of e r", "é", "日", "本", "▁", "　", "ｱ", "\n", "\t", " ", "  ", "𝔸", "ﬁ", "㍿", "\x00", "ß", "<s>",
           "</s>", "<0x41>", "‎", "é", "ﷺ", "한", "한글", "­", "the", " <unk>"]
_LIBRARY = {}


def library(name):
    if name not in _LIBRARY:
        _LIBRARY[name] = (sentencepiece.SentencePieceProcessor(model_proto=MODELS[name]), S.Encoder(MODELS[name]))
    return _LIBRARY[name]


def check(name, texts):
    sp, enc = library(name)
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    ids, begins, ends, at = enc.encode(texts, np.frombuffer(b"".join(raw), np.uint8), off)
    for k, t in enumerate(texts):
        i, j = at[k], at[k + 1]
        assert ids[i:j].tolist() == sp.encode(t, add_bos=True, add_eos=True), (name, t)
        spans = [(p.begin, p.end) for p in sp.encode(t, return_type="proto").pieces]
        assert list(zip(begins[i:j].tolist(), ends[i:j].tolist()))[1:-1] == spans, (name, t)


@pytest.mark.parametrize("name", sorted(MODELS))
def test_equals_the_library(name):
    g = random.Random(5)
    texts = ["", " ", "   ", "   a  b  ", "Hello world", "　　", "▁▁ a", "a" * 5000, " " * 3000, "ab日" * 700, "9f3a" * 900]
    check(name, texts + ["".join(g.choice(LETTERS) for _ in range(g.randrange(1, 25))) for _ in range(600)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=3), st.sampled_from(sorted(MODELS)))
def test_any_text(texts, name):
    check(name, texts)


def test_character_map():
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    m = pb.ModelProto()
    m.ParseFromString(n.serialized_model_proto())
    got = S.character_map(m.normalizer_spec.precompiled_charsmap)
    assert len(got) > 5000 and got["ﬁ"] == "fi" and got["ｱ"] == "ア" and got["é"] == "é"
    assert S.character_map(b"") == {}


def test_cleared_parts_change_nothing(monkeypatch):
    monkeypatch.setattr(S, "HELD_CHARS", 10)
    enc, sp = S.Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for t in ["one two", "two three", "one two"]:
        r = t.encode()
        assert enc.encode([t], np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0].tolist() == sp.encode(t, add_bos=True, add_eos=True)


def test_frames(spark):
    g = random.Random(8)
    rows = [(i, "".join(g.choice(LETTERS) for _ in range(30)), "x", 1) for i in range(300)]
    rows += [(900, "same text", "x", 1), (900, "same text", "x", 1), (None, "no id", "x", 1), (901, None, None, None), (902, "", "x", 1),
             (903, "long text é " * 100_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string, decoded int").repartition(4)
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    got = S.decode(S.encode(df, MODEL), MODEL)
    at_once = S.encode(df, MODEL, decoded="decoded")
    assert at_once.columns == got.columns and sorted(at_once.collect(), key=str) == sorted(got.collect(), key=str)
    assert got.columns == ["doc_id", "text", "ids", "begins", "ends", "decoded"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        want = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == sp.decode(want)
        raw = (r["text"] or "").encode()
        assert b"".join(raw[b:e] for b, e in zip(r["begins"], r["ends"])) == raw  # the spans tile the text
    assert S.encode(df.limit(0), MODEL).collect() == []
    assert S.decode(spark.createDataFrame([(None,)], "ids binary"), MODEL).first()["decoded"] is None


def test_query_equals_the_library(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: tuple(r)[1:] for r in E.queries()["op13_sentence_pieces"](spark, SF_SMALL).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                             hashlib.sha256(sp.decode(ids).encode()).hexdigest(), len((r["text"] or "").encode()))
    assert got == want
