"""From raw labelled texts to the normalised corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions import text as T
from topicweave.plans.tables import materialise

_KEY = ["topic", "doc_id", "orgpath"]


def normalise_corpus(docs: DataFrame, stopwords: Sequence[str] | DataFrame,
                     min_tokens: int = T.MIN_TOKENS) -> DataFrame:
    """``(topic, doc_id, path, text)`` to ``(topic, doc_id, orgpath, tokens, n_tokens)``.

    With a stopword list this is one narrow projection over the scan. A stopword
    table ``word`` of any length is joined instead, with the same result: every
    row of ``docs`` stays a document of its own.
    """
    if isinstance(stopwords, DataFrame):
        tokens = _tokens_without(docs, stopwords)
    else:
        tokens = _generated(docs, T.text_tokens(F.coalesce("text", F.lit("")), stopwords))
    counted = tokens.withColumn("n_tokens", F.size("tokens"))
    return counted.where(F.col("n_tokens") >= min_tokens) if min_tokens > 0 else counted


def _generated(docs: DataFrame, tokens) -> DataFrame:
    """Attach the token column by a one-row generator.

    A filter on a generated column stays above it; on a projected column it would
    be pushed down and the whole normalisation would be evaluated twice.
    """
    return docs.select("topic", "doc_id", F.col("path").alias("orgpath"),
                       F.explode_outer(F.array(tokens)).alias("tokens"))


def _tokens_without(docs: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Tokens but for those in a table.

    The tokens are written once with a number for each row. A row then asks for its
    distinct tokens only and gets back those that are stopwords, so what is
    collected for a row is bounded by its own text.
    """
    plain = _generated(docs, T.text_tokens(F.coalesce("text", F.lit(""))))
    rows = materialise(plain.withColumn("row", F.monotonically_increasing_id()), "plain_tokens")
    asked = rows.select("row", F.explode(F.array_distinct("tokens")).alias("token"))
    listed = stopwords.select(F.col("word").alias("token")).distinct()
    dropped = asked.join(listed, "token").groupBy("row").agg(F.collect_list("token").alias("dropped"))
    kept = F.filter("tokens", lambda token: ~F.array_contains(F.coalesce("dropped", F.array().cast("array<string>")), token))
    return rows.join(dropped, "row", "left").select(*_KEY, kept.alias("tokens"))


def tokenised_corpus(docs: DataFrame) -> DataFrame:
    """Corpus of already tokenised files, one token per line."""
    tokens = T.content_tokens(F.col("text"))
    return docs.select("topic", "doc_id", F.col("path").alias("orgpath"), tokens.alias("tokens"),
                       F.size(tokens).alias("n_tokens"))


def list_topics(corpus: DataFrame) -> DataFrame:
    return corpus.select("topic").distinct()


def documents_of_topic(corpus: DataFrame, topic: str) -> DataFrame:
    """Documents of one topic; on a stored corpus only its partition is read."""
    return corpus.where(F.col("topic") == topic)
