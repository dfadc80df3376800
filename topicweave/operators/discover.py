"""Topic discovery: the topics whose vectors are nearest to a document's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.functions import bits as B
from topicweave.operators.dictionary import Dictionary, document_dimensions
from topicweave.plans.tables import materialise


def vector_distance(n_topic: Column, n_doc: Column, n_shared: Column) -> Column:
    """Euclidean distance of two 0/1 vectors from their counts of ones."""
    return F.sqrt((n_topic + n_doc - 2 * n_shared).cast("double"))


def topic_distances(doc_dims: DataFrame, dictionary: Dictionary, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Distance of each document to the topics it shares a dimension with.

    To any other topic the distance is the root of ``n_topic + n_doc``; those
    pairs are not listed.
    """
    shared = doc_dims.groupBy(*key, "topic_id").agg(F.count("*").alias("n_shared"))
    in_doc = Window.partitionBy(*key)
    return (shared.withColumn("n_doc", F.sum("n_shared").over(in_doc))
            .join(dictionary.topic_vectors.select("topic_id", F.col("n_dims").alias("n_topic")), "topic_id")
            .select(*key, "topic_id", "n_topic", "n_doc", "n_shared",
                    vector_distance(F.col("n_topic"), F.col("n_doc"), F.col("n_shared")).alias("distance")))


def bitmap_distances(pairs: DataFrame, doc_bits: DataFrame, topic_bits: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Distance of given documents and topics from the bits in which their vectors differ.

    ``pairs`` has the key and ``topic_id``. A bucket that one side lacks is empty there, so all its bits on the other side differ.
    """
    pairs = pairs.select(*key, "topic_id")
    of_doc = pairs.join(doc_bits, [*key]).select(*key, "topic_id", "bucket", F.col("words").alias("doc_words"))
    of_topic = pairs.join(topic_bits, "topic_id").select(*key, "topic_id", "bucket", F.col("words").alias("topic_words"))
    met = of_doc.join(of_topic, [*key, "topic_id", "bucket"], "full")
    none = F.array_repeat(F.lit(0).cast("long"), F.lit(B.WORDS))
    n = B.ones(B.either_only(F.coalesce("doc_words", none), F.coalesce("topic_words", none)))
    differing = met.groupBy(*key, "topic_id").agg(F.sum(n).alias("n"))
    return pairs.join(differing, [*key, "topic_id"], "left").select(
        *key, "topic_id", F.sqrt(F.coalesce("n", F.lit(0)).cast("double")).alias("distance"))


def nearest_topics(docs: DataFrame, doc_dims: DataFrame, dictionary: Dictionary,
                   key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """All topics at the smallest distance, for every document.

    Documents are not paired with all topics. The number of differing bits is
    ``n_doc + (n_topic - 2 * n_shared)``, so only the bracket matters. For a topic
    that shares nothing it is ``n_topic``, at best that of the smallest topics;
    and a smallest topic that does share something beats them. So each document is
    left with its best sharing topics, or the smallest topics where these are not
    farther. The list of the smallest topics is one value, bounded by the number of
    topics, that is looked up and not joined. Without any topic vector there is no
    prediction.
    """
    least = dictionary.topic_vectors.agg(F.min("n_dims")).first()[0]
    if least is None:
        return docs.select(*key, F.lit(0).cast("long").alias("topic_id")).where(F.lit(False))
    sizes = dictionary.topic_vectors.select("topic_id", F.col("n_dims").alias("n_topic"))
    shared = doc_dims.groupBy(*key, "topic_id").agg(F.count("*").alias("n_shared"))
    scored = shared.join(sizes, "topic_id").withColumn("excess", F.col("n_topic") - 2 * F.col("n_shared"))
    lowest = F.min("excess").over(Window.partitionBy(*key))
    best = materialise(scored.withColumn("lowest", lowest).where(F.col("excess") == F.col("lowest"))
                       .where(F.col("excess") <= least).select(*key, "topic_id", "excess"), "best_topics")
    settled = best.where(F.col("excess") < least).select(*key).distinct()
    smallest = sizes.where(F.col("n_topic") == least).agg(F.sort_array(F.collect_list("topic_id")).alias("tied"))
    rest = docs.select(*key).join(settled, [*key], "left_anti")
    tied = rest.select(*key, F.explode(smallest.scalar()).alias("topic_id"))
    return best.select(*key, "topic_id").unionByName(tied)


def discover_topics(docs: DataFrame, dictionary: Dictionary, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Predicted topics ``(key, topic)`` of tokenised documents, ties kept.

    ``docs`` holds the key and ``tokens``; one document or many go the same way.
    """
    doc_dims = document_dimensions(docs, dictionary, key)
    return (nearest_topics(docs, doc_dims, dictionary, key)
            .join(dictionary.topics, "topic_id").select(*key, "topic"))
