"""Fill-in-middle documents: a text's units are matched once, and two of their ends are where it is cut.

One ``fullmatch`` of a repeated group over the whole text keeps every repetition; ``match.ends(1)`` then holds the end of
every unit, so their number and both cut offsets are read from it and no unit is visited. The texts are cut in the tasks
of one map over the documents: no row leaves its partition.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustlab.llm import blocks as B
from gustlab.session import small_batches

UNIT = r"[A-Za-z]+|[^A-Za-z]"
SENTINELS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
OUT = "n long, form string, output string, prefix_chars long, middle_chars long"


def draws(id: Column, salt: str) -> list[Column]:
    """Four unsigned 32-bit numbers fixed by the id: the first groups of eight hex digits of the sha256 of
    ``salt:id``. A null id draws as the empty string."""
    h = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cut(text: str, h1: int, h2: int, units) -> tuple[int, int, int]:
    """(number of units, begin of the middle, end of the middle) of a text, offsets in code points."""
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, rate: int = 90,
              spm: int = 20, salt: str = "1", unit: str = UNIT, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` (or its ``keep`` columns) plus ``n`` (units of the text), ``form`` (``plain``, ``psm``, ``spm``), ``output`` (the
    text in that form), ``prefix_chars`` and ``middle_chars`` (code points; null if plain).

    A text is cut after the smaller and the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units (:func:`draws`). ``rate`` in
    a hundred documents are cut, ``spm`` in a hundred of these put the suffix first. A null or empty text, and one
    that contains a sentinel, stays plain (null: an empty output). Rows of one id draw the same numbers, so equal rows
    have equal outputs; repeated rows keep a row each; input columns named like the outputs are replaced. ``unit`` must match
    every text from begin to end when repeated. A task holds the ends of one text's units at a time.
    """
    if any(s[:1] in s[1:] or any(o[:1] in s[1:] for o in sentinels) for s in sentinels) or "" in sentinels:
        raise ValueError("a sentinel's first character must not occur again in a sentinel")
    small_batches(docs.sparkSession)
    new = T.StructType.fromDDL(OUT)
    kept = B.without(docs if keep is None else docs.select(*[F.col(f"`{c}`") for c in keep]), new.names)
    names = kept.columns
    src = docs.select(*[F.col(f"`{c}`") for c in names],
                      *[h.alias(f"__h{i}") for i, h in enumerate(draws(F.col(f"`{id}`"), salt))],
                      F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([*kept.schema.fields, *new.fields])
    pre, suf, mid = sentinels

    def one(t, h1, h2, h3, h4, units):
        n, i, j = cut(t, h1, h2, units)
        if not t or h3 % 100 >= rate or any(s in t for s in sentinels):
            return n, "plain", t, None, None
        if h4 % 100 < spm:
            return n, "spm", f"{suf}{t[j:]}{pre}{t[:i]}{mid}{t[i:j]}", i, j - i
        return n, "psm", f"{pre}{t[:i]}{suf}{t[j:]}{mid}{t[i:j]}", i, j - i

    def run(batches):
        units = regex.compile(f"({unit})*+")
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            _, off = B.utf8(b.column(b.num_columns - 1))
            for i, j in B.row_chunks(off):
                part = b.slice(i, j - i)
                *hs, texts = [part.column(k).to_pylist() for k in range(len(names), b.num_columns)]
                rows = [one(t, *h, units) for t, *h in zip(texts, *hs)]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(names))], *cols], [*names, *new.names])

    return src.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, rebuilt from an output and its form alone; null for a null output."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    part = lambda i: F.element_at(parts, i)  # noqa: E731  the first is what stands before the first sentinel: nothing
    return (F.when(form == "psm", F.concat(part(2), part(4), part(3)))
            .when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output))


ORACLE = r"""
    WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                      sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
    d AS (SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                 ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid,
                 coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM p
"""
