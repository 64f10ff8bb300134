"""Token similarity: Jaccard, coverage, statement-mention and link-recovery scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import urls
from corvane.functions.text import clean_text, content_tokens, key_text, let, match_tokens


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def coverage(part: Column, whole: Column) -> Column:
    """Share of the tokens of ``part`` that ``whole`` has; 0 for no tokens."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(0.0)


def mention_score(statement: Column, label: Column, title: Column, topic: Column, cited: Column | None = None, url: Column | None = None) -> Column:
    """Share of a mention's tokens in the statement, plus 1 if the statement cites its URL."""
    mention = content_tokens(F.concat_ws(" ", label, title, topic))
    score = coverage(mention, content_tokens(statement))
    if cited is None or url is None:
        return score
    return score + F.coalesce(F.array_contains(cited, urls.normalize(url)).cast("double"), F.lit(0.0))


def _inside(a: Column, b: Column, least: int) -> Column:
    return (F.least(F.length(a), F.length(b)) >= least) & (F.contains(a, b) | F.contains(b, a))


def recovery_score(title: Column, label: Column, topic: Column, link_label: Column, link_url: Column) -> Column:
    """How well a link's label matches a mention that lost its URL."""

    def score(n: Column) -> Column:
        t, lab, link = n["title"], n["label"], n["link"]
        points = F.when((t != "") & (t == link), 12.0).otherwise(0.0)
        points += F.when((lab != "") & (lab == link), 10.0).otherwise(0.0)
        points += F.when((t != "") & _inside(t, link, 24), 6.0).otherwise(0.0)
        points += F.when((lab != "") & _inside(lab, link, 18), 4.0).otherwise(0.0)
        for words, weight in ((n["title_words"], 6.0), (n["topic_words"], 4.0), (n["label_words"], 3.0)):
            points += coverage(words, n["link_words"]) * weight
        return F.when(link == "", 0.0).otherwise(points - F.when(n["raw"], 3.0).otherwise(0.0))

    raw = F.coalesce(clean_text(link_label).rlike("^https?://") | urls.normalize(link_label).eqNullSafe(urls.normalize(link_url)), F.lit(False))
    parts = F.struct(
        key_text(title).alias("title"), key_text(label).alias("label"), key_text(link_label).alias("link"), match_tokens(title).alias("title_words"),
        match_tokens(topic).alias("topic_words"), match_tokens(label).alias("label_words"), match_tokens(link_label).alias("link_words"), raw.alias("raw"),
    )
    return let(parts, score)


def confident(title: Column, label: Column, link_label: Column, score: Column) -> Column:
    """Gate of the recovery: an exact title or label, or 5 points."""
    link = key_text(link_label)
    return ((key_text(title) != "") & (key_text(title) == link)) | ((key_text(label) != "") & (key_text(label) == link)) | (score >= 5.0)


def best_match(pairs: DataFrame, keys: list[str], score: str, tie: str, least: float) -> DataFrame:
    """Best right side of each left one, the earliest on ties, if it reaches ``least``."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    return pairs.where(F.col(score) >= least).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def token_join(left: DataFrame, right: DataFrame, left_tokens: str, right_tokens: str) -> DataFrame:
    """Pairs that share a token, without a cross join: explode, equi-join, distinct by the caller's ids."""
    a = left.withColumn("_t", F.explode(left_tokens))
    b = right.withColumn("_t", F.explode(right_tokens))
    return a.join(b, "_t").drop("_t")


def covered(left: DataFrame, left_id: str, left_tokens: str, right: DataFrame, right_id: str, right_tokens: str, least: float, within: str | None = None) -> DataFrame:
    """(left_id, right_id, score): share of the right side's distinct tokens that the left one has, from ``least`` on.

    An inverted index: both sides' tokens meet in one equi-join and shared ones are counted, so only pairs with a common
    token are made. ``within``: a column of both sides that must be equal.
    """
    also = [within] if within else []
    a = left.select(left_id, *also, F.explode(F.array_distinct(left_tokens)).alias("_t"))
    b = right.select(right_id, *also, F.size(F.array_distinct(right_tokens)).alias("_n"), F.explode(F.array_distinct(right_tokens)).alias("_t"))
    shared = a.join(b, [*also, "_t"]).groupBy(left_id, right_id, "_n").agg(F.count("*").alias("_m"))
    return shared.select(left_id, right_id, (F.col("_m") / F.col("_n")).alias("score")).where(F.col("score") >= least)


def top_links(scored: DataFrame, statement: str, key: str, score: str, order: str, least: float = 0.2, k: int = 4) -> DataFrame:
    """Per statement the k best distinct keys from a score of ``least`` on, earliest first on ties."""
    good = scored.where(F.col(score) >= least)
    once = Window.partitionBy(statement, key).orderBy(F.col(score).desc(), order)
    rank = Window.partitionBy(statement).orderBy(F.col(score).desc(), order)
    distinct = good.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return distinct.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
