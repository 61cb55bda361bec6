"""Shapes of the registered queries over whole tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

COLUMNS = {
    "op1": ("embeddings", "vec_id", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op2": ("pages", "page_id", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
    "op3": ("pages", "page_id", "page_id bigint, url string, text string, n_chars bigint"),
    "op4": ("documents", "doc_id", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op5": ("documents", "doc_id", "doc_id bigint, n_tokens bigint"),
    "op6": ("documents", "doc_id", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
    "op7": ("documents", "doc_id", "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"),
    "op8": ("documents", "doc_id", "doc_id bigint, contaminated boolean, item_ids array<bigint>, best_score double"),
    "op9": ("documents", "doc_id", "doc_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op10": ("documents", "doc_id", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op11": ("documents", "doc_id", "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"),
    "op12": ("documents", "doc_id", "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"),
    "op13": ("documents", "doc_id", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint"),
}


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_one_row_a_row_of_its_table(spark, op):
    table, key, columns = COLUMNS[op]
    name = next(n for n in E.queries() if n.startswith(op + "_"))
    got = E.queries()[name](spark, SF_SMALL)
    have = dict(got.dtypes)
    for c in columns.split(", "):
        n, t = c.split(" ")
        assert have[n] == t, (n, have)
    ids = sorted(r[0] for r in got.select(key).collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{SF_SMALL}/{table}.parquet").select(key).collect())
    assert not [c for c in columns.split(", ") if c.split(" ")[0] in ("score", "held_out") and got.where(f"{c.split(' ')[0]} is null").count()]


def test_a_null_id_is_not_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two three", "en", "s", 13) for i in range(12)] + [(None, "one two", "en", "s", 7)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["held_out"] for r in E.queries()["op7_backoff_automaton"](spark, str(tmp_path)).collect()}
    import zlib

    assert got == {**{i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(12)}, None: False}
