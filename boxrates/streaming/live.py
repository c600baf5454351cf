"""Live quotes: stateful merge, and boxes kept up to date by what changed.

The current quotes of a stream are its own state: ``current_quotes`` reads them from the state
store of the query's checkpoint, as of any batch that is still kept there.

Boxes are maintained by a delta join. What two strikes alone decide about a box (its prices
and volumes) is stored; time to expiry, spot and rates follow when boxes are read. A batch
pairs the strikes that it changed with all strikes of their chains and stores those pairs
and the list of changed strikes, in folders of its own. A stored pair counts for as long as
neither of its strikes has changed in a later batch, so nothing has to be deleted when a
strike moves or loses its liquidity. Now and then the pairs that count are written together
and older folders are removed. Repeating a batch after a failure leaves the same result.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import UTC, datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from boxrates.functions.pricing import expiry_time, years_to_expiry
from boxrates.operators.boxes import LEG_COUNTS, box_leg_volumes, box_moneyness, box_prices, box_rates
from boxrates.operators.pairs import pairs_between
from boxrates.operators.quotes import (
    COUNT_FIELDS,
    PRICE_FIELDS,
    SIZE_FIELDS,
    merge_updates,
    parity_spot,
    tracked_only,
    with_mid,
)
from boxrates.operators.strikes import liquid_strikes, pivot_unique, synthetic_forwards
from boxrates.params import ALL, RateParams
from boxrates.plans.collect import run_collection
from boxrates.schema import BOXES, CONTRACT, QUOTES, conform, utc, utc_of, with_order_of
from boxrates.session import work_dir
from boxrates.sources.paths import complete_batches, delete, matching
from boxrates.streaming.status import bootstrap_progress

LOGGER = logging.getLogger(__name__)

MESSAGES = "value string, seq bigint, ts timestamp_ntz"
PAGES = "ticker string, page_no bigint, document string, snapshot_time timestamp_ntz"

# Batches between two full writes of the pairs that count.
BASE_EVERY = 50
# Seeded quotes are numbered below every live message.
SEED_OFFSET = -(1 << 62)

CHAIN_NOW = ["ticker", "expiry"]
STRIKE = [*CHAIN_NOW, "strike"]

_LATE = {"snapshot_time", "tte_years", "mid_rate", "lend_rate", "borrow_rate", "spot_price"}
PAIRS = T.StructType([f for f in BOXES.fields if f.name not in _LATE and not f.name.startswith("moneyness")])
_KINDS = {
    "pairs": PAIRS,
    "strikes": T.StructType([f for f in QUOTES.fields if f.name in STRIKE]),
    "parity": T.StructType(
        [f for f in BOXES.fields if f.name in (*CHAIN_NOW, "spot_price")]
    ),
}


def total_order(time: str, partition: str, offset: str) -> Column:
    """One number per message that orders a topic: by millisecond, then partition, then offset.

    An offset alone orders its partition only. The number depends on where a message lies and
    never on when it arrives, so ties of one millisecond fall the same way in every run.
    Valid for times from 1970 on and up to a million partitions; wider than 64 bits.
    """
    return F.expr(
        f"CAST(unix_millis({time}) AS DECIMAL(38, 0)) * 10000000000000000000000000BD"
        f" + CAST({partition} AS DECIMAL(38, 0)) * 10000000000000000000BD + CAST({offset} AS DECIMAL(38, 0))"
    ).cast("decimal(38,0)")


def read_messages(spark: SparkSession, path: str, fmt: str = "json", **options) -> DataFrame:
    """Stream of messages ``value, seq, ts``.

    ``json`` and ``parquet`` watch a folder of landed messages. For ``kafka``, ``path``
    is the topic, and ``seq`` is the total order of time, partition and offset
    (``total_order``): messages of a contract may lie in several partitions.
    """
    if fmt == "kafka":
        topic = spark.readStream.format("kafka").option("subscribe", path).options(**options)
        return topic.load().select(
            F.col("value").cast("string").alias("value"),
            total_order("timestamp", "partition", "offset").alias("seq"),
            utc_of("timestamp").alias("ts"),
        )
    return spark.readStream.schema(MESSAGES).options(**options).format(fmt).load(path)


def seed_quotes(quotes: DataFrame, path: str) -> None:
    """Store chain quotes that have a symbol as the starting state of a stream."""
    named = quotes.filter(F.coalesce(F.col("symbol"), F.lit("")) != "")
    seeded = conform(named, QUOTES).withColumn("seq", F.col("seq") + SEED_OFFSET)
    seeded.write.mode("overwrite").parquet(path)


def with_seed(quotes: DataFrame, path: str) -> DataFrame:
    """Live quotes preceded by the seeded ones."""
    seed = quotes.sparkSession.readStream.schema(QUOTES).parquet(path)
    schema = with_order_of(QUOTES, quotes)
    return conform(quotes, schema).unionByName(conform(seed, schema))


def _named_state(value: T.StructType) -> T.StructType:
    """The buffers of ``merge_updates`` as the state store holds them, with names of their own."""
    names = []
    for name in [*PRICE_FIELDS, *COUNT_FIELDS, *SIZE_FIELDS, "symbol"]:
        names += [name, f"{name}_at"]
    names += ["n_updates", "seq", "last_update"]
    return T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, value.fields, strict=True)])


def current_quotes(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Current quote of every contract after batch ``batch_id`` (default: the last one).

    Reads the state of the stream that runs, or ran, with ``checkpoint``; its columns are
    those of ``merge_updates``. The last 100 batches can be asked for unless the session
    keeps another number of them (``spark.sql.streaming.minBatchesToRetain``).
    """
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    # The buffers share two names, so they are told apart by their place.
    state = reader.load(checkpoint)
    state = state.select("key", F.col("value").cast(_named_state(state.schema["value"].dataType)).alias("v"))
    types = {f.name: f.dataType for f in QUOTES.fields}
    numbers = [
        F.coalesce(f"v.{f}", F.lit(0)).cast(types[f]).alias(f) for f in [*PRICE_FIELDS, *COUNT_FIELDS]
    ]
    others = [F.col(f"v.{f}").alias(f) for f in [*SIZE_FIELDS, "symbol", "n_updates", "seq", "last_update"]]
    return state.select(*[F.col(f"key.{k}").alias(k) for k in CONTRACT], *numbers, *others)


def _write_batch(df: DataFrame, path: str, kind: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{kind}/batch_id={batch_id}")


def _read_batches(spark: SparkSession, path: str, kind: str, batches: list[int]) -> DataFrame:
    schema = T.StructType([*_KINDS[kind].fields, T.StructField("batch_id", T.LongType())])
    folders = [f"{path}/{kind}/batch_id={b}" for b in batches]
    return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(*folders)


def _start(
    quotes: DataFrame, on_batch, checkpoint: str, trigger: dict, name: str | None = None
) -> StreamingQuery:
    writer = merge_updates(quotes).writeStream.outputMode("update").foreachBatch(on_batch)
    if name:
        writer = writer.queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _scratch(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_merge(
    quotes: DataFrame, checkpoint: str, *, name: str | None = None, **trigger
) -> StreamingQuery:
    """Keep the current quote of every contract of a stream; read it with ``current_quotes``."""

    def on_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.format("noop").mode("overwrite").save()

    return _start(quotes, on_batch, checkpoint, trigger or {"availableNow": True}, name)


def _legs(quotes: DataFrame, params: RateParams) -> DataFrame:
    """What pairing needs of each liquid strike of the current quotes."""
    strikes = pivot_unique(with_mid(quotes), CHAIN_NOW)
    liquid = liquid_strikes(strikes, params.min_volume, params.min_open_interest)
    return synthetic_forwards(liquid).select(*STRIKE, "sfl", "sfs", "sf_mid", *LEG_COUNTS)


def delta_pairs(legs: DataFrame, moved: DataFrame, params: RateParams) -> DataFrame:
    """Prices of all pairs of ``legs`` of which at least one strike is in ``moved``, each once.

    Changed strikes meet all upper strikes of their chain, and the others as lower strikes
    meet changed ones: work linear in the chain for each changed strike.
    """
    marked = legs.join(moved.withColumn("_moved", F.lit(True)), STRIKE, "left")
    moved_too = F.col("_moved").isNotNull()
    # One join for both: changed strikes look among all, the others among the changed ones.
    lower = marked.withColumn("_among", F.when(moved_too, 0).otherwise(1)).drop("_moved")
    places = F.when(moved_too, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    upper = marked.withColumn("_among", F.explode(places)).drop("_moved")
    pairs = pairs_between(
        lower,
        upper.select(*lower.columns),
        [*CHAIN_NOW, "_among"],
        min_gap=params.min_strike_gap,
        max_gap=params.max_strike_gap,
    )
    priced = box_leg_volumes(box_prices(pairs))
    # No time to expiry and no spot makes a box of a pair whose mid price is out of bounds.
    return conform(priced.filter("mid_cost > 0 AND mid_cost < payoff"), PAIRS)


def last_spots(history: DataFrame, stamp: datetime) -> DataFrame:
    """``ticker, feed_price``: the last price of every ticker at ``stamp``.

    ``history`` is as ``spot_as_of`` takes it; at a single time an aggregation finds what
    is valid then.
    """
    order = ["spot_time", *(["seq"] if "seq" in history.columns else []), "spot_price"]
    known = history.filter((F.col("spot_time") <= utc(stamp)) & (F.nanvl("spot_price", F.lit(0.0)) > 0))
    return known.groupBy("ticker").agg(F.max_by("spot_price", F.struct(*order)).alias("feed_price"))


def stream_boxes(
    quotes: DataFrame,
    path: str,
    params: RateParams = RateParams(),
    *,
    tracked: DataFrame | None = None,
    spots: Callable[[], DataFrame] | DataFrame | None = None,
    parity_scope: str | None = "chain",
    as_of: datetime | Callable[[int], datetime] | None = None,
    base_every: int = BASE_EVERY,
    checkpoint: str | None = None,
    name: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep the boxes of a stream of quotes up to date; read them with ``latest_boxes``.

    ``tracked`` limits the stream to its (ticker, expiry) rows. Boxes are stamped with the
    time of the last batch, or ``as_of``, which may be a function of the batch's number.
    ``spots`` is a history ``ticker, spot_time, spot_price``; as a function it is called in
    each batch, so that prices that landed since are seen, and each ticker takes its last
    price at the stamp. Put-call parity, recomputed for the tickers (or expiries, by
    ``parity_scope``) that changed, serves tickers without a price there.

    The default trigger is the configured interval. The checkpoint is below ``path`` unless
    given; a restart with the same one goes on where the stream ended.
    """
    spark = quotes.sparkSession
    checkpoint = checkpoint or f"{path}/checkpoint"
    unit = ["ticker"] if parity_scope == "chain" else CHAIN_NOW
    if tracked is not None:
        quotes = tracked_only(quotes, tracked)

    def on_batch(changed: DataFrame, batch_id: int) -> None:
        stamp = as_of(batch_id) if callable(as_of) else as_of or datetime.now(UTC).replace(tzinfo=None)
        # Written first: read again, it would run the merge again, and without adaptive plans.
        scratch = f"{path}/scratch/{batch_id}"
        changed.write.mode("overwrite").parquet(scratch)
        changed = spark.read.schema(changed.schema).parquet(scratch)
        now = changed
        if batch_id > 0:
            before = current_quotes(spark, checkpoint, batch_id - 1)
            touched = changed.select(*unit).distinct()
            unchanged = before.join(changed, CONTRACT, "left_anti").join(touched, unit, "left_semi")
            now = _scratch(changed.unionByName(unchanged), f"{scratch}-touched")
        moved = changed.select(*STRIKE).distinct()
        chains = changed.select(*CHAIN_NOW).distinct()
        legs = _scratch(_legs(now.join(chains, CHAIN_NOW, "left_semi"), params), f"{scratch}-legs")
        _write_batch(delta_pairs(legs, moved, params), path, "pairs", batch_id)
        _write_batch(moved, path, "strikes", batch_id)
        if parity_scope is not None:
            stamped = now.withColumn("snapshot_time", utc(stamp))
            parity = parity_spot(stamped, parity_scope).drop("snapshot_time")
            found = changed.select(*unit).distinct().join(parity, unit, "left")
            _write_batch(conform(found, _KINDS["parity"]), path, "parity", batch_id)
        if spots is not None:
            history = spots() if callable(spots) else spots
            _write_batch(last_spots(history, stamp), path, "spots", batch_id)
        state = spark.range(1).select(utc(stamp).alias("stamp"), F.lit(params.max_abs_rate).alias("max_abs_rate"))
        _write_batch(state, path, "stamps", batch_id)
        for folder in (scratch, f"{scratch}-touched", f"{scratch}-legs"):
            delete(spark, folder)
        if (batch_id + 1) % base_every == 0:
            _write_base(spark, path, batch_id, parity_scope is not None)

    trigger = trigger or {"processingTime": f"{params.trigger_seconds} seconds"}
    return _start(quotes, on_batch, checkpoint, trigger, name)


def _since_base(
    spark: SparkSession, path: str, upto: int, *, below: int | None = None
) -> tuple[list[int], list[int]]:
    """The newest base (none or one) up to batch ``upto`` and before ``below``, and the batches after it."""
    below = upto + 1 if below is None else below
    bases = [b for b in complete_batches(spark, f"{path}/base") if b < below][-1:]
    after = bases[0] if bases else -1
    return bases, [b for b in complete_batches(spark, f"{path}/stamps") if after < b <= upto]


def _with_base(spark: SparkSession, path: str, kind: str, bases: list[int], batches: list[int]) -> DataFrame:
    """Rows of the batches and of the base, ``at`` telling the batch that each comes from."""
    schema = _KINDS[kind]
    found = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("at", T.LongType())]))
    if batches:
        rows = _read_batches(spark, path, kind, batches).withColumnRenamed("batch_id", "at")
        found = found.unionByName(rows)
    for base in bases:
        found = found.unionByName(spark.read.schema(found.schema).parquet(f"{path}/base_{kind}/batch_id={base}"))
    return found


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, "at")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("at", *others), "at").alias("_last"))
    return last.select(*keys, "_last.*")


def _valid_pairs(spark: SparkSession, path: str, bases: list[int], batches: list[int]) -> tuple[DataFrame, DataFrame]:
    """Stored pairs of whose strikes none changed later, and each strike's last change."""
    strikes = _with_base(spark, path, "strikes", bases, batches).groupBy(*STRIKE).agg(F.max("at").alias("at"))
    pairs = _with_base(spark, path, "pairs", bases, batches)
    for leg in ("kl", "ks"):
        changed = strikes.select(*CHAIN_NOW, F.col("strike").alias(leg), F.col("at").alias(f"_{leg}_at"))
        pairs = pairs.join(changed, [*CHAIN_NOW, leg])
    pairs = pairs.filter(F.col("at") == F.greatest("_kl_at", "_ks_at")).drop("_kl_at", "_ks_at")
    return pairs, strikes


def _write_base(spark: SparkSession, path: str, batch_id: int, parity: bool) -> None:
    """Write together what counts; folders that the base before this one replaced go.

    The mark in ``base`` comes last, so a base that was cut short is never read.
    """
    old, batches = _since_base(spark, path, batch_id, below=batch_id)
    pairs, strikes = _valid_pairs(spark, path, old, batches)
    _write_batch(pairs, path, "base_pairs", batch_id)
    _write_batch(strikes, path, "base_strikes", batch_id)
    if parity:
        prices = _newest(_with_base(spark, path, "parity", old, batches), CHAIN_NOW)
        _write_batch(prices, path, "base_parity", batch_id)
    _write_batch(spark.range(1), path, "base", batch_id)
    # Readers may still be at the base before; what lies before that one is not read again.
    for base in old:
        for kind in ("pairs", "strikes", "parity", "spots", "stamps"):
            for b in complete_batches(spark, f"{path}/{kind}"):
                if b <= base:
                    delete(spark, f"{path}/{kind}/batch_id={b}")
        for kind in ("base_pairs", "base_strikes", "base_parity", "base"):
            for b in complete_batches(spark, f"{path}/{kind}"):
                if b < base:
                    delete(spark, f"{path}/{kind}/batch_id={b}")


def latest_boxes(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """All boxes as of the last batch, or of batch ``batch_id`` since the last but one base."""
    upto = complete_batches(spark, f"{path}/stamps")
    upto = [b for b in upto if batch_id is None or b <= batch_id]
    if not upto:
        return spark.createDataFrame([], BOXES)
    last = upto[-1]
    bases, batches = _since_base(spark, path, last)
    pairs, _ = _valid_pairs(spark, path, bases, batches)
    stamp, most = spark.read.parquet(f"{path}/stamps/batch_id={last}").first()
    expiry_at = expiry_time(F.col("expiry"))
    years = F.when(expiry_at.isNotNull(), years_to_expiry(expiry_at, F.col("snapshot_time")))
    boxes = pairs.drop("at").withColumn("snapshot_time", utc(stamp)).withColumn("tte_years", years)

    found = []
    if last in complete_batches(spark, f"{path}/spots"):
        boxes = boxes.join(spark.read.parquet(f"{path}/spots/batch_id={last}"), "ticker", "left")
        found.append("feed_price")
    if last in complete_batches(spark, f"{path}/parity"):
        parity = _newest(_with_base(spark, path, "parity", bases, batches), CHAIN_NOW)
        # Of a ticker as a whole, parity is stored without an expiry.
        for column, unit in (("whole_price", ["ticker"]), ("parity_price", CHAIN_NOW)):
            rows = parity.filter(F.col("expiry").isNull() if unit == ["ticker"] else F.col("expiry").isNotNull())
            boxes = boxes.join(rows.select(*unit, F.col("spot_price").alias(column)), unit, "left")
            found.append(column)
    spot = F.coalesce(*found) if found else F.lit(None)
    boxes = boxes.withColumn("spot_price", spot.cast("double"))
    boxes = box_moneyness(box_rates(boxes, most))
    return conform(boxes.withColumn("expiry", F.date_format(expiry_time(F.col("expiry")), "yyyy-MM-dd")), BOXES)


def stream_status(
    current: DataFrame,
    params: RateParams = RateParams(),
    *,
    states: DataFrame | None = None,
    bootstrap: DataFrame | None = None,
) -> DataFrame:
    """One row over ``current_quotes``: messages merged, last arrival, contracts, symbols, tickers.

    ``states``, the row of this stream in ``status.stream_states``, adds its state, batches and
    error; ``bootstrap``, of ``status.bootstrap_states``, adds how far the bootstrap is and
    which tickers failed or were empty. The symbols counted there can be subscribed to; where
    there are none, that is the error unless the stream has one of its own.
    """
    status = current.agg(
        F.coalesce(F.sum("n_updates"), F.lit(0)).alias("version"),
        F.max("last_update").alias("last_update"),
        F.count(F.lit(1)).alias("contracts"),
        F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("ticker").alias("tickers_done"),
        F.lit(len(params.tickers)).cast("bigint").alias("tickers_total"),
    )
    columns = [*status.columns]
    error = F.lit(None).cast("string")

    def one_row(df: DataFrame, name: str) -> None:
        nonlocal status
        status = status.withColumn(name, df.select(F.struct(*df.columns)).scalar())

    if states is not None:
        one_row(states.select("state", "batches", "last_progress", "error"), "_stream")
        columns += [F.col(f"_stream.{c}").alias(c) for c in ("state", "batches", "last_progress")]
        error = F.col("_stream.error")
    if bootstrap is not None:
        progress = bootstrap_progress(bootstrap)
        one_row(progress, "_start")
        columns += [F.col(f"_start.{c}").alias(c) for c in progress.columns]
        nothing = F.when(F.col("_start.subscribed") == 0, "no option symbols to subscribe to")
        error = F.coalesce(error, nothing)
    return status.select(*columns, error.alias("error"))


def _keep_pages(landed: DataFrame, kept: str, batch_id: int, stamp: datetime) -> set[datetime]:
    """Keep the pages of a batch, by snapshot; returns the times of their snapshots.

    Pages without a time are of time ``stamp``.
    """
    timed = landed.withColumn("snapshot_time", F.coalesce("snapshot_time", utc(stamp))).withColumn(
        "batch_id", F.lit(batch_id).cast("bigint")
    )
    folders = ["snapshot_time", "batch_id"]
    writer = timed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folders).parquet(kept)
    spark = landed.sparkSession
    return {time for time, folder in _kept_times(spark, kept) if matching(spark, f"{folder}/batch_id={batch_id}")}


def _kept_times(spark: SparkSession, kept: str) -> list[tuple[datetime, str]]:
    folders = matching(spark, f"{kept}/snapshot_time=*")
    return [(datetime.fromisoformat(unquote(f.rsplit("=", 1)[1])), f) for f in folders]


def _kept_pages(spark: SparkSession, kept: str, times: set[datetime], upto: int) -> DataFrame:
    """All pages of the snapshots ``times``, each as it landed last. Other snapshots are not listed."""
    folders = [folder for time, folder in _kept_times(spark, kept) if time in times]
    pages = spark.read.schema(f"{PAGES}, batch_id bigint").option("basePath", kept).parquet(*folders)
    page = Window.partitionBy("snapshot_time", "ticker", "page_no")
    last = pages.filter(F.col("batch_id") <= upto).withColumn("_last", F.max("batch_id").over(page))
    return last.filter(F.col("batch_id") == F.col("_last")).drop("_last", "batch_id")


def collect_on_schedule(
    spark: SparkSession,
    pages_path: str,
    path: str,
    params: RateParams = ALL,
    *,
    as_of: datetime | None = None,
    max_files: int | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Collect newly landed chain pages at the configured interval.

    Pages that bear no ``snapshot_time`` are of time ``as_of``, or of the time of their batch.
    ``max_files`` bounds the files of a batch.

    A collection that fails is logged and ends the query before its batch is committed, so
    the next start from the same ``checkpoint`` reads its pages again. Pages are kept below
    the checkpoint: a snapshot whose pages land in several batches is rebuilt from all of
    them, and a page that lands again replaces the earlier one.
    """
    reader = spark.readStream.schema(PAGES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    pages = reader.json(pages_path)
    checkpoint = checkpoint or work_dir(spark, "collect")
    kept = f"{checkpoint}/landed"

    def on_batch(landed: DataFrame, batch_id: int) -> None:
        try:
            stamp = as_of or datetime.now(UTC).replace(tzinfo=None, microsecond=0)
            times = _keep_pages(landed, kept, batch_id, stamp)
            if times:
                whole = _kept_pages(spark, kept, times, batch_id)
                run_collection(spark, whole, path, params, **options)
        except Exception:
            LOGGER.exception("collection of batch %d failed", batch_id)
            raise

    return (
        pages.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{params.trigger_seconds} seconds"}))
        .start()
    )
