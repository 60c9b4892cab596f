"""Exact deduplication that no group of copies can slow down.

Texts are equal when they are identical after every run of blanks became one space. Copies are combined three times, each
time on the digest *and* the whole text: inside a task, between the tasks of one salt, and between the salts. A group of
copies of any size therefore reaches the last step as at most ``salts`` rows.

Defined results: a null text counts as empty, and empty texts are copies of each other. The smallest id stays; null ids
lose against others, and a group with null ids alone stays under a null id. Rows that repeat an id and a text are one
document in ``keep_one`` (one row is left) and carry the same answer in ``exact_groups``. Columns other than the id and the
text are not read by ``exact_groups`` and are handed on as they are by ``keep_one``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import unused
from riskloom.session import materialise

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def combine(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, body, keep_id, group_size), one row per distinct text."""
    body = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"))
    rows = rows.select("id", "body", digest(F.col("body")).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row.

    Rows find their group by digest alone wherever the digest belongs to one text. Where texts share a digest, the whole
    texts are compared again.
    """
    groups = combine(docs, id_col, text_col, salts, digest).select("digest", "keep_id", "group_size", F.col("body"))
    slim = materialise(groups.select("digest", "keep_id", "group_size"))
    by_digest = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
    alone = by_digest.where("texts = 1").drop("texts")
    shared = by_digest.where("texts > 1").select("digest")
    rows = docs.select(F.col(id_col), digest(normalised(F.col(text_col))).alias("digest"))
    out = rows.join(alone, "digest")
    if not shared.isEmpty():
        bodies = docs.select(F.col(id_col), normalised(F.col(text_col)).alias("body")).withColumn("digest", digest(F.col("body")))
        full = groups.join(shared, "digest", "left_semi")
        out = out.unionByName(bodies.join(full, ["digest", "body"]).drop("body"))
    return out.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows that stay, with all their columns. Joined on digest and id, so that copies are spread over all tasks; a row that
    repeats both is dropped where the join put it, so whole rows are shuffled once."""
    digest, no_id, own, of, none, keep = unused(docs, "__digest", "__no_id", "__own", "__of", "__none", "__keep")
    # a null id and its flag are keys as others are: a null-safe join would shuffle by keys of its own
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    kept = combine(docs, id_col, text_col, salts, sha256)
    kept = kept.select(F.col("digest").alias(of), F.col("keep_id").isNull().alias(none), F.coalesce("keep_id", zero).alias(keep))
    hashed = F.coalesce(sha256(normalised(F.col(text_col))), F.lit(""))  # never null: else Spark hashes twice, once for a filter
    rows = docs.withColumn(digest, hashed).withColumn(no_id, F.col(id_col).isNull()).withColumn(own, F.coalesce(F.col(id_col), zero))
    joined = rows.join(kept, (F.col(digest) == F.col(of)) & (F.col(no_id) == F.col(none)) & (F.col(own) == F.col(keep)))
    return joined.dropDuplicates([digest, no_id, own]).select(*docs.columns)
