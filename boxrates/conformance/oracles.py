"""ANSI SQL counterparts of ``queries``, written for DuckDB over the same tables.

Each statement is a chain of common table expressions: the derived quotes, merged
quotes, strike rows and boxes, followed by the question itself.
"""

from __future__ import annotations

EVENT_QUOTES = """
event_rows AS (
  SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS v,
         event_id % 4 AS e, (event_id * 31 + user_id) % 41 AS s, user_id % 3 AS tk
  FROM events
),
event_priced AS (
  SELECT *,
         CASE WHEN v % 2 = 0 THEN greatest(par, 0.0E0) ELSE greatest(-par, 0.0E0) END + noise AS mc,
         5 + 5 * (v % 4) AS hs
  FROM (
    SELECT *,
           CAST((4500 + 10 * tk - 4000 - 25 * s) * (9800 - 40 * e) AS DOUBLE) / 100.0E0 AS par,
           2000 + 50 * (40 - abs(s - 20)) + (v % 21) - 10 AS noise
    FROM event_rows
  )
),
event_plain AS (
  SELECT event_id AS seq, ts, v,
         CASE tk WHEN 0 THEN 'SPX' WHEN 1 THEN 'VIX' ELSE 'DJX' END AS ticker,
         CASE e WHEN 0 THEN '2024-06-21' WHEN 1 THEN '2024-07-19' WHEN 2 THEN '2024-08-16'
                ELSE '2024-09-20' END AS expiry,
         CAST(4000 + 25 * s AS DOUBLE) AS strike,
         CASE WHEN v % 2 = 0 THEN 'call' ELSE 'put' END AS option_type,
         CASE WHEN v % 17 = 0 THEN 0.0E0 ELSE (mc - hs) / 100.0E0 END AS bid,
         CASE WHEN v % 19 = 0 THEN 0.0E0 ELSE (mc + hs) / 100.0E0 END AS ask,
         CASE WHEN v % 23 = 0 THEN 0.0E0 ELSE (mc - 1) / 100.0E0 END AS last,
         mc / 100.0E0 AS mark,
         v % 200 AS volume, v % 1000 AS open_interest,
         {snapshot} AS snapshot_time
  FROM event_priced
),
q AS (
  SELECT *, ticker || replace(substr(expiry, 3), '-', '')
         || CASE WHEN option_type = 'call' THEN 'C' ELSE 'P' END
         || lpad(CAST(CAST(strike * 1000 AS BIGINT) AS VARCHAR), 8, '0') AS symbol
  FROM event_plain
)"""

LINEITEM_QUOTES = """
line_rows AS (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem
),
line_keyed AS (
  SELECT {ticker} AS ticker, CAST({snapshot} AS TIMESTAMP) AS snapshot_time,
         (l_orderkey * 8 + l_linenumber) * 100000000 + v AS seq, v,
         {s} AS s, {call} AS is_call, CAST(l_quantity AS BIGINT) AS qty
  FROM line_rows
),
line_priced AS (
  SELECT *,
         CASE WHEN is_call THEN greatest(par, 0.0E0) ELSE greatest(-par, 0.0E0) END + noise AS mc,
         5 + 5 * (v % 4) AS hs
  FROM (
    SELECT *,
           CAST((500 - 25 * (s + 20 - {middle})) * 9800 AS DOUBLE) / 100.0E0 AS par,
           2000 + 50 * (40 - abs(s - {middle})) + (v % 21) - 10 AS noise
    FROM line_keyed
  )
),
q AS (
  SELECT seq, ticker, strftime(CAST(snapshot_time AS DATE) + 182, '%Y-%m-%d') AS expiry,
         CAST(4000 + 25 * (s + 20 - {middle}) AS DOUBLE) AS strike,
         CASE WHEN is_call THEN 'call' ELSE 'put' END AS option_type,
         CASE WHEN v % 17 = 0 THEN 0.0E0 ELSE (mc - hs) / 100.0E0 END AS bid,
         CASE WHEN v % 19 = 0 THEN 0.0E0 ELSE (mc + hs) / 100.0E0 END AS ask,
         CASE WHEN v % 23 = 0 THEN 0.0E0 ELSE (mc - 1) / 100.0E0 END AS last,
         mc / 100.0E0 AS mark, qty AS volume, qty * 10 AS open_interest, snapshot_time
  FROM line_priced
)"""

EVENTS = EVENT_QUOTES.format(snapshot="TIMESTAMP '2024-02-01 00:00:00'")
EVENTS_DAILY = EVENT_QUOTES.format(snapshot="CAST(date_trunc('day', ts) AS TIMESTAMP)")
BY_DAY = LINEITEM_QUOTES.format(
    ticker="'LIN'",
    snapshot="l_shipdate",
    s="(l_partkey * 31 + l_suppkey) % 41",
    call="l_suppkey % 2 = 0",
    middle=20,
)
BY_SUPPLIER = LINEITEM_QUOTES.format(
    ticker="'S' || CAST(l_suppkey AS VARCHAR)",
    snapshot="date_trunc('quarter', l_shipdate)",
    s="(l_partkey + l_linenumber) % 9",
    call="v % 2 = 0",
    middle=4,
)

# Current quotes: the latest value that is not 0, per contract of a chain.
MERGED = """
m AS (
  SELECT ticker, expiry, snapshot_time, strike, option_type,
         coalesce(arg_max(bid, seq) FILTER (bid <> 0), 0) AS bid,
         coalesce(arg_max(ask, seq) FILTER (ask <> 0), 0) AS ask,
         coalesce(arg_max(last, seq) FILTER (last <> 0), 0) AS last,
         coalesce(arg_max(mark, seq) FILTER (mark <> 0), 0) AS mark,
         coalesce(arg_max(volume, seq) FILTER (volume <> 0), 0) AS volume,
         coalesce(arg_max(open_interest, seq) FILTER (open_interest <> 0), 0) AS open_interest,
         max(seq) AS seq, count(*) AS n_updates
  FROM {source} GROUP BY ALL
)"""

# Mid, and calls beside puts.
STRIKES = """
mids AS (
  SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2.0E0 ELSE mark END AS mid FROM m
),
k AS (
  SELECT c.ticker, c.expiry, c.snapshot_time, c.strike,
         c.bid AS call_bid, c.ask AS call_ask, c.mid AS call_mid, c.volume AS call_volume,
         c.open_interest AS call_open_interest,
         p.bid AS put_bid, p.ask AS put_ask, p.mid AS put_mid, p.volume AS put_volume,
         p.open_interest AS put_open_interest
  FROM mids c JOIN mids p USING (ticker, expiry, snapshot_time, strike)
  WHERE c.option_type = 'call' AND p.option_type = 'put'
),
f AS (
  SELECT *, call_ask - put_bid AS sfl, call_bid - put_ask AS sfs, call_mid - put_mid AS sf_mid
  FROM k
)"""

# Put-call parity over {parity_source}, by {group}.
PARITY = """
parity_mids AS (
  SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2.0E0
                 WHEN mark <> 0 THEN mark ELSE last END AS pmid
  FROM {source}
),
parity_strikes AS (
  SELECT {group}, strike,
         arg_max(pmid, seq) FILTER (option_type = 'call') AS c,
         arg_max(pmid, seq) FILTER (option_type = 'put') AS p, min(seq) AS first_seq
  FROM parity_mids WHERE pmid > 0 GROUP BY {group}, strike
),
parity_best AS (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY abs(c - p), first_seq) AS rn
  FROM parity_strikes WHERE c IS NOT NULL AND p IS NOT NULL
),
spot AS (
  SELECT {group}, strike + c - p AS spot_price FROM parity_best
  WHERE rn = 1 AND strike + c - p > 0
)"""

BY_TICKER = "ticker, snapshot_time"
BY_EXPIRY = "ticker, snapshot_time, expiry"

NO_SPOT = """
spot AS (
  SELECT DISTINCT ticker, snapshot_time, CAST(NULL AS DOUBLE) AS spot_price FROM f
)"""

BOXES = """
pairs AS (
  SELECT lo.ticker, lo.expiry, lo.snapshot_time, lo.strike AS kl, hi.strike AS ks,
         hi.strike - lo.strike AS width,
         greatest(date_diff('second', lo.snapshot_time, CAST(lo.expiry AS TIMESTAMP))
                  / 31557600.0E0, 0.0001E0) AS tte,
         lo.sfl - hi.sfs AS lend_cost, lo.sfs - hi.sfl AS borrow_proceeds,
         lo.sf_mid - hi.sf_mid AS mid_cost,
         lo.call_volume AS call_kl_volume, hi.call_volume AS call_ks_volume,
         lo.put_volume AS put_kl_volume, hi.put_volume AS put_ks_volume,
         lo.call_open_interest AS call_kl_open_interest,
         hi.call_open_interest AS call_ks_open_interest,
         lo.put_open_interest AS put_kl_open_interest,
         hi.put_open_interest AS put_ks_open_interest
  FROM f lo JOIN f hi USING (ticker, expiry, snapshot_time)
  WHERE lo.strike < hi.strike AND hi.strike - lo.strike BETWEEN 5 AND 400
),
rates AS (
  SELECT *,
         CASE WHEN mid_cost > 0 AND mid_cost < width
              THEN pow(width / mid_cost, 1.0E0 / tte) - 1 END AS mid_r,
         CASE WHEN lend_cost > 0 AND lend_cost < width
              THEN pow(width / lend_cost, 1.0E0 / tte) - 1 END AS lend_r,
         CASE WHEN borrow_proceeds > 0 AND borrow_proceeds < width
              THEN 1 - pow(width / borrow_proceeds, 1.0E0 / tte) END AS borrow_r
  FROM pairs
),
b AS (
  SELECT r.ticker, r.expiry, r.snapshot_time, kl, ks, width, (kl + ks) / 2.0E0 AS mid_strike,
         round(tte, 9) AS tte_years, width AS payoff, round(mid_cost, 6) AS mid_cost,
         round(lend_cost, 6) AS lend_cost, round(borrow_proceeds, 6) AS borrow_proceeds,
         mid_r AS mid_rate,
         CASE WHEN lend_r <= 1 THEN lend_r END AS lend_rate,
         CASE WHEN borrow_r >= -1 THEN borrow_r END AS borrow_rate,
         spot_price, kl / spot_price AS moneyness_kl, ks / spot_price AS moneyness_ks,
         (kl + ks) / 2.0E0 / spot_price AS moneyness_mid,
         call_kl_volume, call_ks_volume, put_kl_volume, put_ks_volume,
         call_kl_open_interest, call_ks_open_interest, put_kl_open_interest,
         put_ks_open_interest,
         least(call_kl_volume, call_ks_volume, put_kl_volume, put_ks_volume) AS min_leg_volume,
         call_kl_volume + call_ks_volume + put_kl_volume + put_ks_volume AS total_leg_volume
  FROM rates r LEFT JOIN spot USING ({spot_keys})
  WHERE mid_r <= 1
)"""

ROUND_RATES = ", ".join(f"round({r}, 6) AS {r}" for r in ("mid_rate", "lend_rate", "borrow_rate"))
ROUND_MONEYNESS = ", ".join(
    f"round({m}, 6) AS {m}" for m in ("moneyness_kl", "moneyness_ks", "moneyness_mid")
)
LEGS = ", ".join(
    f"{side}_{strike}_{count}"
    for count in ("volume", "open_interest")
    for side in ("call", "put")
    for strike in ("kl", "ks")
)
CHAIN = "ticker, expiry, snapshot_time"
FULL = f"""
SELECT {CHAIN}, kl, ks, width, mid_strike, tte_years, payoff, mid_cost, lend_cost,
       borrow_proceeds, {ROUND_RATES}, round(spot_price, 6) AS spot_price, {ROUND_MONEYNESS},
       {LEGS}, min_leg_volume, total_leg_volume
FROM b"""
SCALE = f"SELECT {CHAIN}, kl, ks, {ROUND_RATES}, min_leg_volume FROM b"


def _sql(*ctes: str, select: str) -> str:
    return "WITH" + ",".join(ctes) + "\n" + select


def _boxes(quotes: str, select: str, *more: str, source: str = "q", spot: str | None = None):
    """Boxes ``b`` of a quote table and a question about them."""
    return _sql(
        quotes,
        MERGED.format(source=source),
        STRIKES,
        spot or NO_SPOT,
        BOXES.format(spot_keys=BY_TICKER),
        *more,
        select=select,
    )


EVENT_SPOT = PARITY.format(source="m", group=BY_TICKER)


def _event_boxes(select: str, *more: str) -> str:
    return _boxes(EVENTS, select, *more, spot=EVENT_SPOT)


def _quantiles(group: str) -> str:
    """Term structure by nearest rank, from positions within each group."""
    return f"""
ranked AS (
  SELECT {group}, mid_rate,
         row_number() OVER (PARTITION BY {group} ORDER BY mid_rate) - 1 AS i,
         count(*) OVER (PARTITION BY {group}) AS n
  FROM b
)
SELECT {group}, round(median(mid_rate) * 100, 6) AS median_pct,
       round(avg(mid_rate) * 100, 6) AS mean_pct,
       round(max(mid_rate) FILTER (i = CAST(floor((n - 1) * 0.25E0 + 0.5E0) AS BIGINT)) * 100, 6)
         AS q25_pct,
       round(max(mid_rate) FILTER (i = CAST(floor((n - 1) * 0.75E0 + 0.5E0) AS BIGINT)) * 100, 6)
         AS q75_pct,
       count(*) AS n
FROM ranked GROUP BY {group}"""


def _term(boxes_sql: str, group: str) -> str:
    return boxes_sql + "," + _quantiles(group)


def _top(n: int) -> str:
    order = "ticker, expiry, kl, ks, snapshot_time"
    shown = "ticker, expiry, kl, ks, width, mid_rate, lend_rate, borrow_rate, min_leg_volume"
    return f"""
SELECT side, CAST(rank AS INTEGER) AS rank, {shown} FROM (
  SELECT 'lend' AS side, row_number() OVER (ORDER BY lend_rate DESC, {order}) AS rank, *
  FROM rounded WHERE lend_rate > 0
  UNION ALL
  SELECT 'borrow' AS side, row_number() OVER (ORDER BY borrow_rate DESC, {order}) AS rank, *
  FROM rounded WHERE borrow_rate < 0
) WHERE rank <= {n}"""


ROUNDED = f"""
rounded AS (
  SELECT {CHAIN}, kl, ks, width, min_leg_volume, {ROUND_RATES} FROM b
)"""

TRACKED = """
wanted AS (
  SELECT ticker, expiry FROM (
    SELECT ticker, expiry, row_number() OVER (PARTITION BY ticker ORDER BY expiry) AS rn
    FROM (SELECT DISTINCT ticker, expiry FROM {source})
  ) WHERE rn <= 2
)"""

# Items of landed pages, positions in order of arrival; what a page of objects cannot hold
# lies on a list page of its own.
PAGED = """
paged AS (
  SELECT * EXCLUDE (page_no), page,
         row_number() OVER (PARTITION BY ticker, page ORDER BY seq) - 1 AS position
  FROM (
    SELECT *, CASE WHEN page_no % 4 < 2 AND (blank OR n > 1) THEN 4000000 + page_no * 4 + 3
                   ELSE page_no END AS page
    FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker, page_no, symbol, blank ORDER BY seq DESC) AS n
      FROM (SELECT *, seq // 200 AS page_no, seq % 29 = 0 AS blank FROM q)
    )
  )
),
items AS (
  SELECT ticker, page AS page_no, page * 1048576 + position AS item_seq, seq AS event_seq, blank,
         CASE WHEN blank THEN '' ELSE expiry END AS expiry, strike, option_type, bid, ask, last,
         mark, volume, open_interest,
         CASE WHEN NOT blank AND seq % 4 = 1 THEN seq END AS bid_size,
         CASE WHEN NOT blank AND seq % 4 = 2 THEN seq END AS ask_size,
         CASE WHEN NOT blank THEN symbol END AS symbol
  FROM paged
)"""

# Stream messages that can be read.
HEARD = """
heard AS (
  SELECT *, CASE WHEN NOT named THEN seq END AS bid_size, CASE WHEN named THEN seq END AS ask_size
  FROM (SELECT *, (seq % 11) % 2 = 0 AS named FROM q WHERE seq % 11 <> 0)
)"""

STREAM_TRACKED = """
tracked AS (
  SELECT heard.* FROM heard JOIN wanted USING (ticker, expiry) WHERE ticker <> 'VIX'
)"""

_STREAM_MERGE = """
SELECT ticker, expiry, strike, option_type,
       coalesce(arg_max(bid, seq) FILTER (bid <> 0), 0) AS bid,
       coalesce(arg_max(ask, seq) FILTER (ask <> 0), 0) AS ask,
       coalesce(arg_max(last, seq) FILTER (last <> 0), 0) AS last,
       coalesce(arg_max(mark, seq) FILTER (mark <> 0), 0) AS mark,
       coalesce(arg_max(volume, seq) FILTER (volume <> 0), 0) AS volume,
       coalesce(arg_max(open_interest, seq) FILTER (open_interest <> 0), 0) AS open_interest,
       arg_max(bid_size, seq) FILTER (bid_size IS NOT NULL) AS bid_size,
       arg_max(ask_size, seq) FILTER (ask_size IS NOT NULL) AS ask_size,
       count(*) AS n_updates
FROM {source} GROUP BY ticker, expiry, strike, option_type"""

STREAM_STATE = (EVENTS, HEARD, TRACKED.format(source="q"), STREAM_TRACKED)

# Contracts of the collected snapshot, numbered as they lie on the pages.
COLLECTED = """
merged AS (
  SELECT * FROM m
),
numbered AS (
  SELECT ticker, expiry, snapshot_time, strike, option_type, bid, ask, last, mark, volume,
         open_interest,
         page_no * 1048576
           + row_number() OVER (PARTITION BY ticker, page_no, snapshot_time ORDER BY seq) - 1 AS seq
  FROM (SELECT *, seq // 200 AS page_no FROM merged)
)"""

# Boxes of the earliest three expiries that each snapshot of a ticker lists.
COLLECTED_BOXES = """
listed AS (
  SELECT DISTINCT ticker, snapshot_time, expiry,
         dense_rank() OVER (PARTITION BY ticker, snapshot_time ORDER BY expiry) AS nth
  FROM numbered
)"""


def _collected(quotes: str) -> str:
    return _sql(
        quotes,
        MERGED.format(source="q"),
        COLLECTED,
        STRIKES,
        PARITY.format(source="numbered", group=BY_TICKER),
        BOXES.format(spot_keys=BY_TICKER),
        COLLECTED_BOXES,
        select=SCALE + " JOIN listed USING (ticker, snapshot_time, expiry) WHERE nth <= 3",
    )


_LEGACY = """
wide AS (
  SELECT lo.ticker, lo.expiry, lo.strike * 200 AS kl, hi.strike * 200 AS ks,
         (round(lo.call_mid * 200) + round(hi.put_mid * 200))
           - (round(lo.put_mid * 200) + round(hi.call_mid * 200)) AS cost
  FROM k lo JOIN k hi USING (ticker, expiry, snapshot_time)
  WHERE lo.strike < hi.strike AND hi.strike - lo.strike <= 400
)"""

ORACLES: dict[str, str] = {
    "quote_mid": _sql(
        EVENTS,
        select="""
SELECT seq, ticker, expiry, strike, option_type, bid, ask,
       CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2.0E0 ELSE mark END AS mid
FROM q""",
    ),
    "quote_merge_latest": _sql(
        EVENTS,
        MERGED.format(source="q"),
        select="""
SELECT ticker, expiry, strike, option_type, bid, ask, last, mark, volume, open_interest,
       ticker || replace(substr(expiry, 3), '-', '')
         || CASE WHEN option_type = 'call' THEN 'C' ELSE 'P' END
         || lpad(CAST(CAST(strike * 1000 AS BIGINT) AS VARCHAR), 8, '0') AS symbol,
       n_updates
FROM m""",
    ),
    "call_put_pivot": _sql(EVENTS, MERGED.format(source="q"), STRIKES, select="SELECT * FROM k"),
    "call_put_pivot_fused": _sql(
        EVENTS, MERGED.format(source="q"), STRIKES, select="SELECT * FROM k"
    ),
    "liquid_strikes": _sql(
        EVENTS,
        MERGED.format(source="q"),
        STRIKES,
        select=f"""
SELECT {CHAIN}, strike, call_volume, put_volume, call_open_interest, put_open_interest FROM k
WHERE least(call_volume, put_volume, call_open_interest, put_open_interest) >= 20""",
    ),
    "synthetic_forwards": _sql(
        EVENTS,
        MERGED.format(source="q"),
        STRIKES,
        select=f"SELECT {CHAIN}, strike, sfl, sfs, sf_mid FROM f",
    ),
    "strike_pairs": _sql(
        EVENTS,
        MERGED.format(source="q"),
        STRIKES,
        select=f"""
SELECT {CHAIN}, lo.strike AS kl, hi.strike AS ks, hi.strike - lo.strike AS width,
       (lo.strike + hi.strike) / 2.0E0 AS mid_strike
FROM k lo JOIN k hi USING ({CHAIN})
WHERE lo.strike < hi.strike AND hi.strike - lo.strike BETWEEN 5 AND 400""",
    ),
    "strike_pairs_unbounded": _sql(
        BY_SUPPLIER,
        MERGED.format(source="q"),
        STRIKES,
        select=f"""
SELECT {CHAIN}, lo.strike AS kl, hi.strike AS ks
FROM k lo JOIN k hi USING ({CHAIN}) WHERE lo.strike < hi.strike""",
    ),
    "box_rates": _event_boxes(
        f"SELECT {CHAIN}, kl, ks, tte_years, payoff, mid_cost, lend_cost, borrow_proceeds,"
        f" {ROUND_RATES} FROM b"
    ),
    "box_moneyness": _event_boxes(
        f"SELECT {CHAIN}, kl, ks, round(spot_price, 6) AS spot_price, {ROUND_MONEYNESS} FROM b"
    ),
    "box_moneyness_feed": _sql(
        EVENTS,
        MERGED.format(source="q"),
        STRIKES,
        PARITY.format(source="q", group=BY_EXPIRY).replace("spot AS", "parity_spot AS"),
        """
feed AS (
  SELECT 'SPX' AS ticker, round(max(value), 2) AS feed_price FROM events
),
spot AS (
  SELECT c.ticker, c.expiry, c.snapshot_time, coalesce(feed_price, p.spot_price) AS spot_price
  FROM (SELECT DISTINCT ticker, expiry, snapshot_time FROM q) c
  LEFT JOIN feed USING (ticker)
  LEFT JOIN parity_spot p USING (ticker, snapshot_time, expiry)
)""",
        BOXES.format(spot_keys=BY_EXPIRY),
        select=f"""
SELECT {CHAIN}, kl, ks, round(spot_price, 6) AS spot_price,
       round(moneyness_mid, 6) AS moneyness_mid
FROM b""",
    ),
    "box_leg_volumes": _event_boxes(
        f"SELECT {CHAIN}, kl, ks, {LEGS}, min_leg_volume, total_leg_volume FROM b"
    ),
    "boxes_full": _event_boxes(FULL),
    "boxes_from_current": _event_boxes(FULL),
    "boxes_scale": _boxes(BY_DAY, SCALE),
    "boxes_by_supplier": _boxes(BY_SUPPLIER, SCALE),
    "boxes_daily": _boxes(EVENTS_DAILY, SCALE),
    "legacy_box": _sql(
        EVENTS,
        MERGED.format(source="q"),
        STRIKES,
        _LEGACY,
        select="""
SELECT ticker, expiry, kl, ks, cost AS net_cost,
       CASE WHEN cost = 0 THEN 0 WHEN abs(rate) < 1000 THEN round(rate, 6) ELSE round(rate, 1) END
         AS implied_rate,
       CASE WHEN cost > 0 THEN 'lend' WHEN cost < 0 THEN 'borrow' ELSE 'flat' END AS lend_borrow
FROM (SELECT *, abs(pow((ks - kl) / abs(nullif(cost, 0)), 2.0E0) - 1) * sign(cost) AS rate FROM wide)""",
    ),
    "chain_items": _sql(
        EVENTS,
        PAGED,
        select="""
SELECT ticker, page_no, item_seq AS seq,
       CASE WHEN page_no % 4 < 2 THEN symbol END AS default_symbol
FROM items""",
    ),
    "chain_quotes": _sql(
        EVENTS,
        PAGED,
        select="""
SELECT ticker, expiry, strike, option_type, bid, ask, last, mark, volume, open_interest,
       bid_size, ask_size, symbol, item_seq AS seq
FROM items WHERE NOT blank""",
    ),
    "quotes_for_expiry": _sql(
        EVENTS,
        PAGED,
        """
dated AS (
  SELECT * FROM items WHERE NOT blank
)""",
        TRACKED.format(source="dated"),
        select="""
SELECT ticker, expiry, strike, option_type, bid, ask, symbol, item_seq AS seq
FROM dated JOIN wanted USING (ticker, expiry)
UNION ALL
SELECT i.ticker, w.expiry, strike, option_type, bid, ask, symbol, item_seq AS seq
FROM items i JOIN wanted w ON i.ticker = w.ticker WHERE blank""",
    ),
    "snapshot_roundtrip": _boxes(BY_SUPPLIER, FULL),
    "snapshot_files_parquet": _boxes(BY_SUPPLIER, FULL),
    "snapshot_files_csv": _boxes(BY_SUPPLIER, FULL),
    "snapshot_file_status": "SELECT CAST(5 AS BIGINT) AS file_count, true AS dated",
    "snapshot_history": _boxes(
        BY_SUPPLIER,
        f"""
SELECT {CHAIN}, kl, ks FROM b
WHERE snapshot_time >= TIMESTAMP '1999-11-16 00:00:00'
   OR snapshot_time = (SELECT max(snapshot_time) FROM b)""",
    ),
    "snapshot_retained": _boxes(
        BY_SUPPLIER,
        f"""
SELECT {CHAIN}, kl, ks FROM b
WHERE snapshot_time IN (
  SELECT DISTINCT snapshot_time FROM b ORDER BY snapshot_time DESC LIMIT 6)""",
    ),
    "snapshot_status": _boxes(
        BY_SUPPLIER,
        "SELECT count(DISTINCT snapshot_time) AS snapshots, max(snapshot_time) AS last_snapshot"
        " FROM b",
    ),
    "collector_status": _boxes(
        BY_SUPPLIER,
        """
SELECT count(*) FILTER (snapshot_time = newest) AS rows, max(snapshot_time) AS last_snapshot
FROM b, (SELECT max(snapshot_time) AS newest FROM b)""",
    ),
    "stream_merge": _sql(EVENTS, HEARD, select=_STREAM_MERGE.format(source="heard")),
    "stream_seeded": _sql(
        EVENTS,
        HEARD,
        """
seeded AS (
  SELECT q.* EXCLUDE (seq), q.seq - 4611686018427387904 AS seq
  FROM q JOIN events ON q.seq = event_id WHERE event_type = 'view'
),
both_ AS (
  SELECT ticker, expiry, strike, option_type, bid, ask, last, mark, volume, open_interest,
         bid_size, ask_size, seq FROM heard
  UNION ALL
  SELECT ticker, expiry, strike, option_type, bid, ask, last, mark, volume, open_interest,
         NULL, NULL, seq FROM seeded
)""",
        select=_STREAM_MERGE.format(source="both_"),
    ),
    "stream_boxes": _sql(
        *STREAM_STATE,
        MERGED.format(source="tracked"),
        STRIKES,
        EVENT_SPOT,
        BOXES.format(spot_keys=BY_TICKER),
        select=f"""
SELECT {CHAIN}, kl, ks, round(spot_price, 6) AS spot_price, {ROUND_RATES}, total_leg_volume
FROM b""",
    ),
    "stream_status": _sql(
        *STREAM_STATE,
        select="""
SELECT count(*) AS version, max(snapshot_time) AS last_update,
       count(DISTINCT symbol) AS contracts, count(DISTINCT symbol) AS symbols,
       count(DISTINCT ticker) AS tickers_done, CAST(3 AS BIGINT) AS tickers_total,
       'stopped' AS state, CAST(4 AS BIGINT) AS batches,
       CAST(3 AS BIGINT) AS bootstrap_done, CAST(3 AS BIGINT) AS bootstrap_total,
       'VIX' AS tickers_failed, 'DJX' AS tickers_empty,
       (SELECT count(DISTINCT symbol) FROM q WHERE ticker = 'SPX') AS subscribed,
       CAST(NULL AS VARCHAR) AS error
FROM tracked""",
    ),
    "stream_merge_by_time": _sql(
        EVENTS_DAILY,
        HEARD,
        select=_STREAM_MERGE.format(source="heard").replace(
            "count(*) AS n_updates", "count(*) AS n_updates, max(snapshot_time) AS last_update"
        ).replace(", seq)", ", (snapshot_time, seq))"),
    ),
    "landed_pages": _sql(
        EVENTS,
        MERGED.format(source="q"),
        COLLECTED,
        select="""
SELECT ticker, seq // 1048576 AS page_no, seq,
       ticker || replace(substr(expiry, 3), '-', '')
         || CASE WHEN option_type = 'call' THEN 'C' ELSE 'P' END
         || lpad(CAST(CAST(strike * 1000 AS BIGINT) AS VARCHAR), 8, '0') AS default_symbol
FROM numbered WHERE seq // 1048576 < 40""",
    ),
    "object_messages": _sql(
        EVENTS,
        select="""
SELECT ticker, expiry, strike, option_type, bid, ask, volume AS bid_size, open_interest AS ask_size, seq
FROM q WHERE seq % 13 > 0""",
    ),
    "heatmap_wide": _event_boxes(
        "SELECT kl, ks, round(avg(mid_rate) * 100, 6) AS rate_pct FROM b"
        " WHERE expiry = '2024-07-19' GROUP BY kl, ks"
    ),
    "percent_texts": _event_boxes(
        _top(50).replace("SELECT side,", "SELECT CAST(rank AS INTEGER) AS rank, round(lend_rate * 100, 2) AS lend_pct FROM (SELECT side,", 1)
        + ") WHERE side = 'lend'",
        ROUNDED.replace(", 6)", ", 4)"),
    ),
    "view_of_few_columns": _event_boxes(
        "SELECT side, rank, ticker, expiry, kl, ks, lend_rate, borrow_rate FROM (" + _top(20) + ")",
        ROUNDED.replace("FROM b", "FROM b WHERE ticker = 'SPX'"),
    ),
    "collect_snapshot": _collected(EVENTS_DAILY),
    "collect_scheduled": _collected(EVENTS),
    "rate_curve": _event_boxes(
        "SELECT mid_strike, round(mid_rate * 100, 6) AS rate_pct, width FROM b"
        " WHERE expiry = '2024-07-19'"
    ),
    "term_structure": _term(_event_boxes(""), "ticker, expiry"),
    "term_structure_pooled": _term(_event_boxes(""), "expiry"),
    "term_structure_scale": _term(_boxes(BY_SUPPLIER, ""), "ticker, expiry"),
    "rate_heatmap": _event_boxes(
        "SELECT kl, ks, round(avg(mid_rate) * 100, 6) AS rate_pct FROM b"
        " WHERE expiry = '2024-07-19' GROUP BY kl, ks"
    ),
    "rate_heatmap_scale": _boxes(
        BY_DAY, "SELECT kl, ks, round(avg(mid_rate), 6) AS rate FROM b GROUP BY kl, ks"
    ),
    "heatmap_sample": _boxes(
        BY_DAY,
        """
SELECT kl, ks, round(avg(mid_rate), 6) AS rate FROM b GROUP BY kl, ks
ORDER BY md5('42|' || CAST(CAST(round(kl * 1000) AS BIGINT) AS VARCHAR) || '|'
             || CAST(CAST(round(ks * 1000) AS BIGINT) AS VARCHAR)), kl, ks
LIMIT 200""",
    ),
    "lend_borrow": _event_boxes(
        """
SELECT mid_strike, round(lend_rate * 100, 6) AS lend_pct, round(borrow_rate * 100, 6) AS borrow_pct,
       round(lend_rate * 100 - borrow_rate * 100, 6) AS gap_pct
FROM b WHERE expiry = '2024-07-19' AND lend_rate IS NOT NULL AND borrow_rate IS NOT NULL"""
    ),
    "top_opportunities": _event_boxes(_top(10), ROUNDED),
    "top_opportunities_scale": _boxes(BY_SUPPLIER, _top(100), ROUNDED),
    "view_filtered": _event_boxes(
        f"""
SELECT {CHAIN}, kl, ks, width, min_leg_volume, round(mid_rate, 6) AS mid_rate FROM b
WHERE ticker = 'SPX' AND min_leg_volume >= 10 AND width BETWEEN 25 AND 250
  AND abs(moneyness_mid - 1) <= 0.05E0"""
    ),
    "expiries_per_ticker": _sql(
        EVENTS, TRACKED.format(source="q"), select="SELECT ticker, expiry FROM wanted"
    ),
    "view_expiries": _event_boxes("SELECT DISTINCT ticker, expiry FROM b"),
    "parity_spot_chain": _sql(
        EVENTS,
        PARITY.format(source="q", group=BY_TICKER),
        select="SELECT ticker, snapshot_time, spot_price FROM spot",
    ),
    "parity_spot_expiry": _sql(
        EVENTS,
        PARITY.format(source="q", group=BY_EXPIRY),
        select="SELECT ticker, snapshot_time, expiry, spot_price FROM spot",
    ),
    "parity_spot_daily": _sql(
        EVENTS_DAILY,
        PARITY.format(source="q", group=BY_TICKER),
        select="SELECT ticker, snapshot_time, spot_price FROM spot",
    ),
    "tracked_quotes": _sql(
        EVENTS,
        TRACKED.format(source="q"),
        select="""
SELECT seq, ticker, expiry, strike, option_type, bid, ask
FROM q JOIN wanted USING (ticker, expiry) WHERE ticker <> 'VIX'""",
    ),
    "universe_symbols": _sql(EVENTS, select="SELECT DISTINCT symbol FROM q"),
    "opra_parse": _sql(
        EVENTS,
        select="""
SELECT seq,
       CASE seq % 7 WHEN 0 THEN lower(symbol) WHEN 1 THEN ticker || '   ' || substr(symbol, 4)
                    WHEN 2 THEN ticker || '240230C04000000'
                    WHEN 3 THEN 'x' || CAST(seq AS VARCHAR) ELSE symbol END AS symbol,
       CASE WHEN seq % 7 NOT IN (2, 3) THEN ticker END AS root,
       CASE WHEN seq % 7 NOT IN (2, 3) THEN expiry END AS expiry,
       CASE WHEN seq % 7 NOT IN (2, 3) THEN strike END AS strike,
       CASE WHEN seq % 7 NOT IN (2, 3) THEN option_type END AS option_type
FROM q""",
    ),
    "underlying": _sql(
        EVENTS,
        """
written AS (
  SELECT seq, ticker,
         CASE seq % 7 WHEN 0 THEN lower(symbol) WHEN 1 THEN ticker || '   ' || substr(symbol, 4)
                      WHEN 2 THEN ticker || '240230C04000000'
                      WHEN 3 THEN 'x' || CAST(seq AS VARCHAR) ELSE symbol END AS symbol
  FROM q
)""",
        select="""
SELECT seq, symbol, CASE WHEN seq % 7 IN (2, 3) THEN symbol ELSE ticker END AS underlying
FROM written""",
    ),
    "stream_quotes": _sql(
        EVENTS,
        HEARD,
        select="""
SELECT ticker, expiry, strike, option_type, bid, ask, last, mark, volume, open_interest,
       bid_size, ask_size, symbol, seq
FROM heard""",
    ),
    "underlying_price": """
SELECT ticker, snapshot_time, arg_min(value, event_id) AS spot_price FROM (
  SELECT CASE user_id % 3 WHEN 0 THEN 'SPX' WHEN 1 THEN 'VIX' ELSE 'DJX' END AS ticker,
         CAST(date_trunc('day', ts) AS TIMESTAMP) AS snapshot_time, event_id, value
  FROM events WHERE event_id % 6 IN (1, 2, 5)
) GROUP BY ticker, snapshot_time""",
    "expiry_timestamp": _sql(
        EVENTS,
        select="""
SELECT seq,
       CASE seq % 5 WHEN 0 THEN replace(expiry, '-', '') WHEN 1 THEN expiry || 'T16:00:00'
                    WHEN 2 THEN expiry || 'T16:00:00-05:00'
                    WHEN 3 THEN '2024-13-' || substr(expiry, 9) ELSE expiry END AS written,
       CASE WHEN seq % 5 IN (0, 4) THEN CAST(expiry AS TIMESTAMP)
            WHEN seq % 5 IN (1, 2) THEN CAST(expiry || ' 16:00:00' AS TIMESTAMP) END AS expiry_at
FROM q""",
    ),
}
