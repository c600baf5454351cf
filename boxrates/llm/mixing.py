"""Mixing sources to target weights by capped water-filling.

Each source gets words in proportion to its weight, but at most ``max_epochs`` times its
own size. Sources above that are clamped and their excess is dealt out again in
proportion to the weights of the others, until no source is above. Sizes, ranks and sums
are Spark aggregations; only scalars reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from boxrates.llm.common import stored, text_of

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 17


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """Distinct sources with their rank by code point from 0, NULL last.

    Ranges of sources are ranked apart and then shifted, so no task sees all sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    placed = stored(
        sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources"
    )
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).collect()
    shift, before = {}, 0
    for row in sorted(sizes):  # one row per task of the range partitioning
        shift[row.part] = before
        before += row.n
    shifts = placed.sparkSession.createDataFrame(
        list(shift.items()), T.StructType().add("part", "integer").add("shift", "long")
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    ranked = placed.withColumn("within", within).join(F.broadcast(shifts), "part")
    return ranked.withColumn("rank", F.col("within") + F.col("shift")).drop("part", "within", "shift")


@dataclass(frozen=True)
class Level:
    """The water level: a source gets its cap, or else ``level`` times its weight."""

    level: float
    rounds: int


def water_level(sources: DataFrame, total: int, max_epochs: int = MAX_EPOCHS) -> Level:
    """Clamp and deal out again until no free source is above its cap.

    ``sources`` has ``weight`` and ``source_size``. The level only rises, so a round is an
    aggregation over the sources, and the last one clamps nothing new.
    """
    cap = F.col("source_size") * max_epochs
    level, clamped, rounds = 0.0, -1, 0
    while True:
        is_clamped = F.lit(False) if clamped < 0 else F.col("weight") * level > cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(is_clamped, cap)), F.lit(0)).alias("filled"),
            F.coalesce(F.sum(F.when(~is_clamped, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count_if(is_clamped).alias("n"),
        ).first()
        rounds += 1
        if row.n == clamped or not row.weight:
            return Level(level, rounds)
        clamped = row.n
        level = max(level, float(total - row.filled) / float(row.weight))


def targets(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``; ``docs`` has ``size``."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(sums)
    picks = F.array(*[F.lit(w) for w in weights])
    weighed = stored(
        ranked.withColumn("weight", F.get(picks, (F.col("rank") % len(weights)).cast("int"))).drop(
            "rank"
        ),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(weighed, total, max_epochs).level
    cap = (F.col("source_size") * max_epochs).cast("double")
    return weighed.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def draw(seed: int) -> Column:
    """A seeded number in [0, 1) per ``doc_id``, the same in every run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def mixed(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs`` with the words that the mix takes of it.

    Adds ``size, source_size, target, epochs, taken``; further columns are kept, those of
    these names are replaced. A document is repeated whole ``floor(epochs)`` times; of the
    remaining fraction of its words, a seeded draw decides how the last word is rounded, so
    that a source's words come to its target within the roundings.

    - NULL and empty texts have size 0 and nothing is taken of them.
    - A NULL source is a source of its own and the last in order.
    - Equal rows are dealt with alike. An empty table gives an empty table.
    """
    own = ["size", "source_size", "weight", "target", "epochs", "taken"]
    sized = docs.drop(*own).withColumn("size", n_words(text_of()))
    chosen = targets(sized.select("source", "size"), weights=weights, max_epochs=max_epochs)
    same = sized["source"].eqNullSafe(chosen["source"])
    joined = sized.join(chosen.drop("weight"), same).drop(chosen["source"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    words = F.floor(F.col("epochs") * F.col("size") + draw(seed)).cast("bigint")
    return joined.withColumn("epochs", share).withColumn(
        "taken", F.least(words, F.col("size") * max_epochs)
    )


def repeated(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as the mix takes it, same columns.

    Whole repetitions carry the whole text. The fractional one carries a run of its words,
    joined by blanks, from a seeded place on; ``n_chars``, where there is one, follows.
    """
    seed = params.get("seed", SEED)
    columns = docs.columns
    taken = mixed(docs, **params)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    copies = taken.withColumn("_whole", whole.cast("int")).withColumn(
        "_rest", (F.col("taken") - F.col("_whole") * F.col("size")).cast("int")
    )
    n = F.col("_whole") + F.when(F.col("_rest") > 0, 1).otherwise(0)
    rows = copies.filter(n > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), n)))
    part = F.col("_copy") > F.col("_whole")
    all_words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    start = F.floor(draw(seed + 1) * (F.col("size") - F.col("_rest") + 1)).cast("int") + 1
    cut = F.array_join(F.slice(all_words, start, F.col("_rest")), " ")
    rows = rows.withColumn("text", F.when(part, cut).otherwise(F.col("text")))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn(
            "n_chars", F.when(part, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return rows.select(*columns)
