"""Queries of the operators for training data (problems 1, 6, 7, 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import packing, percentiles, prose, tokenizer
from skyloom.session import checkpointed, table

ALPHA = 0.005
LEVELS = {"band": ["band"], "source": ["source_id"], "source_band": ["source_id", "band"]}
VALUES = {"flux": "flux", "snr": "snr"}


def _rounded(df: DataFrame) -> DataFrame:
    """Percentiles to nine digits, as text: numbers of any size compare alike."""
    names = [percentiles.name(q) for q in percentiles.QUANTILES]
    return df.select(*[F.format_string("%.8e", F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per band, per source, and per both, from one sketch."""
    s = percentiles.sketch(table(spark, d, "lightcurve"), VALUES, ["source_id", "band"], ALPHA)
    return percentiles.by_levels(s, LEVELS, ALPHA)


def p1_by_load(spark: SparkSession, d: str) -> DataFrame:
    """Per band: sketches of each load and day of loading, written, then added up."""
    lc = table(spark, d, "lightcurve").withColumn("day", F.to_date("loaded_at"))
    daily = checkpointed(percentiles.sketch(lc, VALUES, ["load_id", "day", "band"], ALPHA))
    return _rounded(percentiles.percentiles(percentiles.merge(daily, groups=["band"]), ["band"], ALPHA))


def p1_levels(spark: SparkSession, d: str) -> DataFrame:
    """``p1_percentiles`` to nine digits as text."""
    return _rounded(p1_percentiles(spark, d)).drop("error_bound")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), "doc_id")


def p6_lengths(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_counts(table(spark, d, "documents"), "doc_id")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(p6_lengths(spark, d), "doc_id", "n_tokens")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p7_packing(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.not_prose(table(spark, d, "documents"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return prose.score(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that no language is needed for."""
    s = prose.document_statistics(table(spark, d, "documents"), words=prose.Words())
    return s.select("doc_id", "n_chars", "n_trimmed", "n_words", *[F.round(c, 9).alias(c) for c in ("word_length", "symbol_ratio", "digit_ratio", "line_end_ratio")])


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_by_load, p1_levels, p6_ids, p6_lengths, p7_packing, p7_containers, p8_found, p8_statistics, p8_counts)}

_G = (1 + ALPHA * (1 - 1e-9)) / (1 - ALPHA * (1 - 1e-9))


def _level_sql(level: str, groups: list[str]) -> str:
    """Percentiles of one level straight from the readings."""
    g, all_ = ", ".join(groups), ("source_id", "band")
    kinds = {"source_id": "bigint", "band": "varchar"}
    out = ", ".join(c if c in groups else f"NULL::{kinds[c]} AS {c}" for c in all_)
    at = percentiles.offset(ALPHA)
    at_rank = ", ".join(f"min(b) FILTER (upto >= floor({q}::double * (total - 1)) + 1) AS {percentiles.name(q)}" for q in percentiles.QUANTILES)
    value = "CASE WHEN {c} = 0 THEN 0 ELSE sign({c}) * exp((abs({c}) - {at}) * ln({g!r}::double) - ln((1 + {g!r}::double) / 2)) END"
    values = ", ".join(f"printf('%.8e', {value.format(c=c, at=at, g=_G)}) AS {c}" for c in map(percentiles.name, percentiles.QUANTILES))
    return f"""SELECT '{level}' AS level, {out}, quantity, n, {values} FROM (
SELECT {g}, quantity, max(total)::bigint AS n, {at_rank} FROM (
SELECT *, sum(n) OVER (PARTITION BY {g}, quantity) AS total, sum(n) OVER (PARTITION BY {g}, quantity ORDER BY b) AS upto FROM (
SELECT {g}, quantity, CASE WHEN x = 0 THEN 0 ELSE sign(x) * (ceil(ln(abs(x)) / ln({_G!r}::double)) + {at}) END AS b, count(*) AS n FROM (
SELECT source_id, band, 'flux' AS quantity, flux AS x FROM lightcurve UNION ALL SELECT source_id, band, 'snr', snr FROM lightcurve)
WHERE x IS NOT NULL AND isfinite(x) GROUP BY ALL)) GROUP BY ALL)"""


SQL = {
    "p1_by_load": f"SELECT * EXCLUDE (level, source_id) FROM ({_level_sql('band', ['band'])})",
    "p1_levels": " UNION ALL ".join(_level_sql(k, g) for k, g in LEVELS.items()),
}

_BLANK = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_TAGS = _BLANK + "\\x{e000}"
_OWN = "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in prose.UNSPACED)


def _set(chars: str) -> str:
    """``chars`` within brackets of a regular expression within a string of SQL."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


SQL["p8_counts"] = f"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{prose.MARKUP}', chr(57344), 'g') AS c FROM documents),
x AS (SELECT *, regexp_replace(c, '[{_TAGS}]', '', 'g') AS solid, length(regexp_replace(c, '[^{_OWN}]', '', 'g')) AS own,
  regexp_extract_all(regexp_replace(c, '[{_OWN}]', ' ', 'g'), '[\\p{{L}}\\p{{M}}]*\\p{{L}}[\\p{{L}}\\p{{M}}]*') AS w,
  list_filter(regexp_split_to_array(c, '[{_set(prose.LINE_ENDS)}]'), lambda x: regexp_matches(x, '[^{_TAGS}]')) AS l FROM c),
y AS (SELECT *, len(w) + ceil(own / 2)::bigint AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) + own AS letters, length(solid) AS k,
  len(list_filter(l, lambda x: regexp_matches(x, '[{_set(prose.SENTENCE_ENDS + ":")}][{_TAGS}{_set(prose.CLOSERS)}]*$'))) AS ended FROM x)
SELECT doc_id, length(t) AS n_chars, length(regexp_replace(t, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')) AS n_trimmed, n AS n_words,
  round(CASE WHEN n > 0 THEN letters / n ELSE 0 END, 9) AS word_length,
  round(CASE WHEN k > 0 THEN length(regexp_replace(solid, '[\\p{{L}}\\p{{M}}\\p{{N}}{_set(prose.PUNCTUATION)}]', '', 'g')) / k ELSE 0 END, 9) AS symbol_ratio,
  round(CASE WHEN k > 0 THEN length(regexp_replace(solid, '[^\\p{{Nd}}]', '', 'g')) / k ELSE 0 END, 9) AS digit_ratio,
  round(CASE WHEN len(l) > 0 THEN ended / len(l) ELSE 0 END, 9) AS line_end_ratio FROM y"""
