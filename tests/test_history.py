from datetime import timedelta

import pytest
from helpers import AT, rows
from pyspark.errors import AnalysisException

from boxrates.operators import views
from boxrates.schema import BOXES, conform, utc
from boxrates.sources import snapshots


def stored(spark, path, n, per=40):
    """``n`` snapshots an hour apart."""
    boxes = spark.range(n * per).selectExpr(
        "concat('T', id % 2) AS ticker", "'2026-07-02' AS expiry",
        f"timestamp_ntz'{AT}' + make_dt_interval(0, CAST(id DIV {per} AS INT)) AS snapshot_time",
        "CAST(id AS DOUBLE) AS kl", "CAST(id + 1 AS DOUBLE) AS ks", "CAST((id * 7919) % 1009 AS DOUBLE) / 1000 AS mid_rate",
    )
    boxes = conform(boxes, BOXES)
    snapshots.write_snapshot(boxes, path)
    return boxes


def files_read(df):
    """How many files the Parquet scans of a query opened."""
    df.collect()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numFiles").value())
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_answers_open_only_the_files_they_need(spark, tmp_path):
    path = str(tmp_path / "table")
    stored(spark, path, 9)
    hour = timedelta(hours=1)
    kept = snapshots.retained_history(spark, path, 3)
    assert {r[0] for r in rows(kept, "snapshot_time")} == {AT + 6 * hour, AT + 7 * hour, AT + 8 * hour}
    assert files_read(kept) == 3
    recent = snapshots.recent_history(spark, path, as_of=AT + 8 * hour, minutes=60)
    assert files_read(recent) == 2
    late = snapshots.recent_history(spark, path, as_of=AT + 99 * hour, minutes=60)
    assert files_read(late) == 1 and {r[0] for r in rows(late, "snapshot_time")} == {AT + 8 * hour}
    status = snapshots.history_status(spark, path)
    assert rows(status) == [(9, AT + 8 * hour)] and files_read(status) == 0
    progress = snapshots.collector_progress(spark, path)
    assert rows(progress) == [(40, AT + 8 * hour)] and files_read(progress) == 1
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    assert rows(snapshots.history_status(spark, path)) == [(9, AT + 8 * hour)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_mistyped_path_is_an_error_and_an_empty_history_has_a_status(spark, tmp_path):
    absent = str(tmp_path / "absent")
    for read in (snapshots.scan_snapshots, snapshots.snapshot_listing):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            read(spark, absent)
    assert rows(snapshots.history_status(spark, absent)) == [(0, None)]
    assert rows(snapshots.collector_progress(spark, absent)) == [(0, None)]


@pytest.mark.parametrize("by", [("ticker", "expiry"), ("expiry",)])
def test_sketches_of_snapshots_merge_within_their_error(spark, tmp_path, by):
    boxes = stored(spark, str(tmp_path / "table"), 6, per=4000)
    sketches = views.rate_sketches(boxes)
    assert sketches.count() == 12
    exact = {r[: len(by)]: r for r in rows(views.term_structure(boxes, by))}
    ranks = {}
    for r in boxes.select(*by, "mid_rate").collect():
        ranks.setdefault(tuple(r[: len(by)]), []).append(r.mid_rate * 100)
    for r in views.term_structure_of_sketches(sketches, by).collect():
        key = tuple(r[: len(by)])
        assert r.n == exact[key][-1] and r.mean_pct == pytest.approx(exact[key][len(by) + 1])
        values = ranks[key]
        for value, rank in ((r.median_pct, 0.5), (r.q25_pct, 0.25), (r.q75_pct, 0.75)):
            below, upto = sum(v < value - 1e-9 for v in values), sum(v <= value + 1e-9 for v in values)
            assert below / r.n - r.rank_error <= rank <= upto / r.n + r.rank_error
        assert r.rank_error < 0.02
    # The newest snapshots alone, from the same sketches.
    newest = sketches.filter(sketches.snapshot_time >= utc(AT + timedelta(hours=4)))
    assert {r.n for r in views.term_structure_of_sketches(newest, ("expiry",)).collect()} == {8000}
