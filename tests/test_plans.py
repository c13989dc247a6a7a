"""Whole jobs."""


from pyspark.sql import functions as F

from conftest import SF, frame
from tapework.plans import forecast, ingest, scoring
from tapework.sources import files, registry
from tapework.sources.fixtures import bars


def test_ingest_can_be_repeated(spark, tmp_path):
    df = bars(spark, SF)
    raw = files.land_raw(df.withColumn("adj_close", F.col("close")), str(tmp_path), "2025-01-01")
    for _ in range(2):
        rules = ingest.ingest(spark, raw, str(tmp_path / "bars"))
        assert {r.rule: r.passed for r in rules.collect()}["stored_covers_processed"]
    stored = files.read_bars(spark, str(tmp_path / "bars"))
    assert stored.count() == df.count()
    failed = {r.rule for r in rules.where(~F.col("passed")).collect()}
    assert failed == {"continuity"}


def test_training_writes_models_that_score(spark, walk_df, tmp_path):
    path = str(tmp_path / "registry")
    folds = scoring.train(walk_df, path, min_ic=-1.0, min_sharpe=-100.0)
    assert folds.where("ticker = 'HOT'").count() == 4
    models = registry.read_lines(spark, path)
    row = models.where("ticker = 'HOT'").first()
    assert len(row.parameters.weights) == 28 == row.n_features
    asked = spark.createDataFrame([("HOT",), ("NEW",)], "ticker string")
    first = scoring.score_latest(walk_df, models, asked)
    got = {r.ticker: r for r in first.collect()}
    assert got["HOT"].direction in ("UP", "DOWN", "SIDEWAYS") and got["NEW"].error == "Unsupported ticker"
    again = scoring.score_latest(walk_df, models, asked, first.where("error is null").select("ticker", "date"))
    assert {r.ticker for r in again.collect()} == {"NEW"}
    out = str(tmp_path / "results")
    day = {r.ticker: (r.date, r.predicted_log_return) for r in scoring.score_daily(walk_df, models, asked, out).collect()}
    stored = spark.read.parquet(out)
    assert [r.ticker for r in stored.collect()] == ["HOT"]
    # The second call of the day takes the stored result; models are not asked again.
    twice = {r.ticker: (r.date, r.predicted_log_return) for r in scoring.score_daily(walk_df, models, asked, out).collect()}
    assert twice == day and spark.read.parquet(out).count() == 1


def test_flagship(spark):
    got = frame(forecast.ranked_report(bars(spark, SF)), ["rank"])
    assert got["rank"].tolist() == [1, 2, 3, 4, 5] and got["avg_sharpe"].is_monotonic_decreasing


def test_no_whole_series_window(spark):
    """No window or sort in a feature plan is keyed by the instrument alone, except over slot totals."""
    from tapework.operators import features
    plan = features.training_frame(bars(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:
        assert "_slot" in line or "_block" in line or "sum(_c" in line, line


def test_plans_hold_no_cross_join(spark):
    from tapework.operators import clean, model, stats
    rows = bars(spark, SF)
    for df in (clean.fill_chain(clean.align(rows), ["close"]), stats.box_stats(rows), stats.density_curve(rows),
               model.ols1_forecast(model.lag_frame(rows)), model.walk_forward_forecast(model.lag_frame(rows))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_days_extend_features_without_history(spark, walk_df):
    """Day by day from the carries: the rows that recomputing from all bars gives, gaps filled from the past only."""
    from tapework import schemas as S
    from tapework.operators import features
    from tapework.plans import extend

    names = S.training_features()
    cut = walk_df.selectExpr("percentile_approx(date, 0.9) as d").first().d
    old, new = walk_df.where(F.col("date") <= F.lit(cut)), walk_df.where(F.col("date") > F.lit(cut))
    none = spark.createDataFrame([], extend.CARRY)
    first, carries = extend.extend(old, none)
    days = sorted(r.date for r in new.select("date").distinct().collect())
    got = {}
    for part in (days[:3], days[3:]):
        rows, carries = extend.extend(new.where(F.col("date").between(part[0], part[-1])), carries)
        got |= {(r.ticker, r.date): r for r in rows.collect()}
    assert {(r.ticker, r.date) for r in new.collect()} == set(got)
    assert carries.count() == walk_df.select("ticker").distinct().count()
    # The batch form, whose back fill cannot reach rows after 200 earlier ones.
    whole = {(r.ticker, r.date): r for r in features.inference_frame(walk_df).where(F.col("date") > F.lit(cut)).collect()}
    for key in [k for k in got if k[0] in ("HOT", "B")]:
        for n in names:
            assert abs(got[key][n] - whole[key][n]) < 1e-9 * max(1, abs(whole[key][n])), (key, n)
    again, same = extend.extend(new, carries)  # bars that have been seen add nothing
    assert again.count() == 0 and sorted(r.last for r in same.collect()) == sorted(r.last for r in carries.collect())
