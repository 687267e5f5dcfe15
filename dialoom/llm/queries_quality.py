"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import quality
from dialoom.session import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mainly no running prose, with their type."""
    typed = quality.types(_documents(spark, sf_dir), "doc_id", "text", "lang", table(spark, sf_dir, "common_words"))
    return typed.filter(F.col("kind") != "prose").select(F.col("id").alias("doc_id"), "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document."""
    measured = quality.statistics(_documents(spark, sf_dir), "text", "lang", table(spark, sf_dir, "common_words"))
    return measured.select("doc_id", *[F.round(f"q.{c}", 6).alias(c) for c in ("words", "mean_word", "symbols", "punct_lines", "common", "lines")])


def p10_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned types against the labelled sample."""
    typed = quality.types(_documents(spark, sf_dir), "doc_id", "text", "lang", table(spark, sf_dir, "common_words"))
    labels = table(spark, sf_dir, "doc_labels").select(F.col("doc_id").alias("id"), F.col("kind").alias("label"))
    return labels.join(typed, "id").groupBy("label", "kind").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics, "p10_agreement": p10_agreement}
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_EVERY = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
ORACLES: dict[str, str] = {
    "p10_statistics": rf"""WITH w AS (SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) FILTER (WHERE lang = 'zh') AS zh, list(word) FILTER (WHERE lang = 'en') AS en FROM common_words),
d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, CAST({_COUNT.format('t', r"[\p{Han}]|[^\P{L}\p{Han}](?:[^\P{L}\p{Han}]|[\p{M}''’\-])*|[\p{N}]+")} AS DOUBLE) AS words, {_COUNT.format('t', r"[\p{L}\p{N}]")} AS letters,
  {_COUNT.format('t', r"[\p{S}#%&*+/<=>@\\^_|~\[\]{{}}§°¤$]")} AS symbols, length(regexp_replace(t, '{_EVERY}+', '', 'g')) AS chars,
  list_filter(string_split_regex(t, '\r\n|[\n\r\x{{2028}}\x{{2029}}\x0b\x0c\x{{85}}]'), lambda x: length(trim(x, ' ')) > 0) AS ls,
  CASE WHEN lang = 'en' THEN 0 ELSE len(regexp_extract_all(lower(t), zh)) END + CASE WHEN lang = 'zh' THEN 0 ELSE len(list_filter(regexp_extract_all(lower(t), '[a-z]+'), lambda x: list_contains(en, x))) END AS common FROM d, w)
SELECT doc_id, words, round(letters / greatest(words, 1), 6) AS mean_word, round(symbols / greatest(chars, 1), 6) AS symbols,
  round(len(list_filter(ls, lambda x: regexp_matches(x, '[。！？；.!?;…：:”"’)）]\s*$'))) / greatest(len(ls), 1), 6) AS punct_lines, round(common / greatest(words, 1), 6) AS common, CAST(len(ls) AS DOUBLE) AS lines FROM c""",
}
