"""Whether replies follow given scripts to the letter: keyword patterns with mandatory words and templates.

A reply hits a pattern if it holds enough of its keywords (``min_matches`` of them, or the share ``min_ratio``), all of
its mandatory ones, and, where the pattern has a template, follows that to ``fuzzy_threshold``. Of the patterns it hits
the best counts: by score, keywords found, the category's priority, then in the order of the patterns.

Null and blank replies hit nothing. A pattern without keywords, or that no keyword is needed for, is an error, as such
a pattern could be found by comparing everything with everything only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.functions.similarity import template_similarity
from dialoom.operators.scripts import MAX_SCRIPTS, small

# The order of the categories where score and keywords are equal.
CATEGORY_ORDER = ("province_analysis", "module_explanation", "course_overview", "follow_up", "homework_feedback", "general_force_compliance", "class_invitation")
LAST = 99
HIT = ("pattern_id", "category", "name", "matched", "score")


def hits(replies: DataFrame, patterns: DataFrame, order: tuple[str, ...] = CATEGORY_ORDER) -> DataFrame:
    """(text, pattern_id, category, name, matched, score) of the distinct texts that hit a pattern.

    ``patterns``: pattern_id, category, name, keywords, mandatory, min_matches, min_ratio, template, fuzzy_threshold;
    pattern_id is their order. Candidates are found through the first two characters of a keyword, or its only one.
    """
    patterns = patterns.select("pattern_id", "category", "name", "keywords", "mandatory", "min_matches", "min_ratio", "template", "fuzzy_threshold")
    bad = F.coalesce(F.size("keywords") < 1, F.lit(True)) | (F.col("min_matches") < 1) | (F.col("min_ratio") <= 0)
    if patterns.filter(bad).limit(1).count():
        raise ValueError("every pattern needs keywords, and at least one of them in a reply")
    texts = replies.select("text").distinct().withColumn("clean", T.without_attachments(F.col("text"))).filter("clean <> ''").withColumn("id", F.unhex(F.md5("text")))
    starts = small(patterns.select("pattern_id", F.explode(F.array_distinct(F.transform("keywords", lambda k: F.substring(k, 1, 2)))).alias("gram")), 40 * MAX_SCRIPTS)
    pairs = texts.select("id", F.explode(F.array_distinct(T.char_ngrams(F.col("clean"), (1, 2)))).alias("gram")).join(starts, "gram").select("id", "pattern_id").distinct()
    joined = pairs.join(texts, "id").join(small(patterns), "pattern_id")
    found = F.filter("keywords", lambda k: F.col("clean").contains(k))
    scored = joined.withColumns({"found": found, "ratio": F.size(found) / F.size("keywords")})
    enough = (F.size("found") >= F.col("min_matches")) | (F.col("ratio") >= F.col("min_ratio"))
    passed = scored.filter(enough & F.forall("mandatory", lambda m: F.array_contains("found", m)))
    bare = F.coalesce(F.col("template"), F.lit("")) == ""
    follows = template_similarity(F.when(~bare, T.template_form(F.col("clean"))), F.when(~bare, T.template_form(F.col("template"))))
    judged = passed.withColumn("fuzzy", follows).filter(bare | (F.col("fuzzy") >= F.col("fuzzy_threshold")))
    score = F.greatest("ratio", "fuzzy")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("category")).cast("int"), F.lit(0))
    rank = F.struct(-F.round(score, 9), -F.size("found"), F.when(place == 0, LAST).otherwise(place), "pattern_id")
    best = F.min_by(F.struct("text", "pattern_id", "category", "name", F.size("found").alias("matched"), F.round(score, 4).alias("score")), rank)
    return judged.groupBy("id").agg(best.alias("b")).select("b.*")


def annotate(replies: DataFrame, column: str, patterns: DataFrame, order: tuple[str, ...] = CATEGORY_ORDER) -> DataFrame:
    """The replies with ``is_hit`` and the hit's pattern, category, name, keywords found and score; defaults without one."""
    found = hits(replies.select(F.col(column).alias("text")).filter("text is not null"), patterns, order)
    joined = replies.join(found.withColumnRenamed("text", column), column, "left")
    defaults = {"category": F.lit(""), "name": F.lit(""), "matched": F.lit(0), "score": F.lit(0.0)}
    return joined.withColumns({"is_hit": F.col("pattern_id").isNotNull(), **{c: F.coalesce(c, d) for c, d in defaults.items()}})
