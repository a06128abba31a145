"""Fill-in-middle: texts cut in three at unit borders and put in another order, with digests.

One Arrow-batched pandas UDF, no shuffle. A text's units are found once by `finditer`, whose end offsets
lie in a compact array; two lookups in it give the two cuts. All random choices come from SHA-256 of the
seed and doc_id, so a rerun or another partitioning gives the same rows. A unit is a word with the white
space before it, or white space at the end.

Defined cases: a null text is empty; an empty text, or one that holds a marker, stays plain, so that the
text can always be rebuilt from output and form; a null doc_id counts as the empty string; each row has its
own result, so repeated rows and ties change nothing; extra columns are ignored; an empty table gives an
empty result. Long texts are cut whole: beside the text there are eight bytes a unit.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The seed, per cent of texts that are cut, and per cent of these that begin with the suffix.
SEED, CUT, SUFFIX_FIRST = 42, 50, 80
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def arranged(key: str, text: str, seed: int, cut: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    ends = array("Q", (m.end() for m in UNIT.finditer(text)))
    n = len(ends)
    first, second, whether, which = draws(key, seed)
    if not n or whether % 100 >= cut or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    before, after = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (before, after))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if which % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text again, from output and form alone: no part of a cut text holds a marker."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, rest = output.removeprefix(PREFIX).split(SUFFIX)
        suffix, middle = rest.split(MIDDLE)
    else:
        suffix, rest = output.removeprefix(SUFFIX).split(PREFIX)
        prefix, middle = rest.split(MIDDLE)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transform(docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256) of each row."""

    @F.pandas_udf(RESULT)
    def cut_up(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for key, text in zip(keys, texts):
            n, form, prefix, middle, output = arranged(key, text, seed, cut, suffix_first)
            rows.append((n, form, prefix, middle, output, _sha256(output), _sha256(rebuilt(output, form))))
        names = [f.split()[0] for f in RESULT.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", cut_up(key, text).alias("x")).select(F.col("doc_id").cast("long").alias("doc_id"), "x.*")


def restore(transformed: DataFrame) -> DataFrame:
    """The frame with a column `restored`: the text rebuilt from its output and form."""

    @F.pandas_udf("string")
    def build(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return transformed.withColumn("restored", build("output", "form"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(table(spark, sf_dir, "documents")).drop("output")


OP13_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') units
  from documents),
d as (
  select *, len(units) n,
    ('0x' || substr(h, 1, 8))::ubigint h1, ('0x' || substr(h, 9, 8))::ubigint h2,
    ('0x' || substr(h, 17, 8))::ubigint h3, ('0x' || substr(h, 25, 8))::ubigint h4 from t),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1))::bigint a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint b,
    case when n = 0 or h3 % 100 >= 50 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
         when h4 % 100 < 80 then 'spm' else 'psm' end form from d),
p as (
  select *, coalesce(array_to_string(units[1:a], ''), '') pre, coalesce(array_to_string(units[a + 1:b], ''), '') mid,
    coalesce(array_to_string(units[b + 1:], ''), '') suf from c),
o as (
  select *, case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end output from p)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(pre) end::bigint prefix_chars,
  case when form <> 'plain' then length(mid) end::bigint middle_chars, sha256(output) output_sha256,
  sha256(case form when 'plain' then output else pre || mid || suf end) restored_sha256
from o
"""
