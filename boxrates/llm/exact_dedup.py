"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Equal texts are merged in three stages, and each stage groups by the whole text besides its
digest, so texts are never taken for equal on a digest alone:

1. locally: the map side of the first aggregation leaves one row per text and task,
2. by salted digest group: copies of one text meet in ``salts`` different tasks,
3. globally: at most ``salts`` winners of a text meet in one task.

A text that makes up a third of the rows therefore costs a task no more than one row per
map task and salt. The winners are stored without their texts; rows find their winner by
digest, and by the text as well where a digest stands for several texts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxrates.llm.common import digest_of, stored, text_of

SALTS = 16


def normalise(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    letters = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    # For pure ASCII the two are the same, and lower() is faster.
    return F.when(plain, F.lower(text)).otherwise(letters)


def _rows(docs: DataFrame, digest) -> DataFrame:
    norm = normalise(text_of())
    return docs.select("doc_id", norm.alias("norm")).withColumn("digest", digest(F.col("norm")))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """One row per text: digest, norm, keep_id, group_size."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    by_salt = (
        rows.groupBy("digest", salt.alias("salt"), "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    # Dealt by digest alone, so that texts that share a digest lie together.
    return (
        by_salt.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def copies(docs: DataFrame, *, salts: int = SALTS, digest=digest_of) -> DataFrame:
    """Every row of ``docs`` with the row that stays of its group.

    Input: ``doc_id``, ``text`` and any other columns, which are ignored. Output, one row per
    input row: ``doc_id, keep_id, group_size, kept, digest``.

    - NULL text is the empty text, and all empty texts are one group.
    - The largest ``doc_id`` stays; NULL ids come below all others.
    - Rows that repeat both text and the largest id are all marked ``kept``;
      ``drop_copies`` leaves one of them.
    - An empty table gives an empty table.
    - ``digest`` may be any function of the text: texts that it confuses stay apart.
    """
    rows = _rows(docs, digest)
    winners = stored(
        _winners(rows, salts)
        .groupBy("digest")
        .agg(
            F.count("*").alias("n_texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "copies",
    )
    single = winners.filter("n_texts = 1").drop("n_texts")
    found = rows.drop("norm").join(single, "digest")
    mixed = winners.filter("n_texts > 1").select("digest")
    if not mixed.isEmpty():
        unclear = rows.join(mixed, "digest", "left_semi")
        found = found.unionByName(
            unclear.join(_winners(unclear, salts), ["digest", "norm"]).drop("norm")
        )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_copies(docs: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``; one for each text.

    Texts equal but for the case of A-Z are copies, as for ``copies``; of rows that repeat
    the largest id too, any one stays.
    """
    kept = copies(docs, salts=salts).filter("kept").select("doc_id", "digest").distinct()
    keyed = docs.withColumn("_digest", digest_of(normalise(text_of())))
    same = keyed["doc_id"].eqNullSafe(kept["doc_id"]) & (keyed["_digest"] == kept["digest"])
    return (
        keyed.join(kept.hint("shuffle_hash"), same, "left_semi")
        .dropDuplicates(["doc_id", "_digest"])
        .drop("_digest")
    )
