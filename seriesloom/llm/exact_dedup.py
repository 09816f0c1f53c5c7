"""Exact duplicates, combined in three stages that each compare whole contents.

1. Every task combines its own rows of a text (the map side of the aggregate).
2. Groups of (digest, salt, text) merge; the salt is taken from the id, so a text
   that holds a third of all rows is spread over ``salts`` groups.
3. The salt winners of a digest, at most ``salts`` a text, meet and are combined.

Winners go back to the rows by (digest, salt), along the salts that stage 2 has
seen (one bit each, so 64 at most); no task sees a whole hot group.  Two texts of one SHA-256 digest would be
seen in stage 3 and stop the job instead of being merged.

Nulls and empty texts are equal to each other.  A null id is smaller than any
other.  Rows that share id and text are one document: each is reported, ``kept``
alike; ``drop_exact`` leaves one of them.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import fold

SALTS = 64


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(fold(text), 256))


def _salt(doc_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int")


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    key, content = docs[doc_id].cast("long"), docs[text]
    merged = (
        docs.select(key.alias("doc_id"), _digest(content).alias("digest"), _salt(key, salts).alias("salt"), fold(content).alias("content"))
        .groupBy("digest", "salt", "content")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    winners = (
        merged.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.expr("bit_or(shiftleft(1L, salt))").alias("seen"))
        .groupBy("digest")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max("seen").alias("seen"), F.count(F.lit(1)).alias("texts"))
    )
    alone = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
    slots = F.expr(f"filter(sequence(0, {salts - 1}), k -> (shiftright(seen, k) & 1) = 1)")
    routes = winners.select("digest", F.explode(slots).alias("salt"), "keep_id", alone.alias("group_size"))
    rows = docs.select(key.alias("doc_id"), _digest(content).alias("digest"), _salt(key, salts).alias("salt"))
    return rows.join(routes, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """Columns of ``docs``, of each group of equal texts the row with the largest id."""
    def key(column: Column) -> Column:  # no null: the join and the removal of repeated rows share one partitioning
        return F.coalesce(column.cast("long").cast("string"), F.lit(""))

    kept = (
        exact_duplicates(docs, doc_id=doc_id, text=text, salts=salts)
        .filter("kept")
        .select(key(F.col("doc_id")).alias("__key"), F.unhex("text_sha256").alias("__digest"))
    )
    rows = docs.withColumns({"__key": key(docs[doc_id]), "__digest": _digest(docs[text])})
    return rows.join(kept, ["__key", "__digest"], "left_semi").dropDuplicates(["__key", "__digest"]).select(*docs.columns)
