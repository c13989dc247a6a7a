"""Bounded-piece operators against whole-series pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import frame, same
from tapework.operators import clean
from tapework.operators import series as R


def numbered(df):
    return R.with_position(df, ["ticker"], ["date"])


def test_positions_count_from_zero_per_series(small_blocks, walk, walk_df):
    got = frame(numbered(walk_df))
    want = walk.sort_values(["ticker", "date"])
    assert got[R.POS].tolist() == want.groupby("ticker").cumcount().tolist()
    assert got[R.ROWS].tolist() == want.groupby("ticker")["date"].transform("size").tolist()


@pytest.mark.parametrize("back,ahead", [(1, 0), (5, 0), (16, 0), (3, 4), (0, 9)])
def test_tiled_equals_whole_window(small_blocks, walk, walk_df, back, ahead):
    def build(rows, w):
        return rows.withColumns({"b": F.lag("close", back).over(w) if back else F.lit(None).cast("double"),
                                 "a": F.lead("close", ahead).over(w) if ahead else F.lit(None).cast("double")})
    got = frame(R.tiled(numbered(walk_df), ["ticker"], build, back, ahead))
    want = walk.sort_values(["ticker", "date"]).groupby("ticker")["close"]
    assert len(got) == len(walk)
    if back:
        same(got["b"], want.shift(back))
    if ahead:
        same(got["a"], want.shift(-ahead))


def test_tiled_rejects_blocks_smaller_than_their_edges(walk_df):
    with pytest.raises(ValueError):
        R.tiled(numbered(walk_df), ["ticker"], lambda r, w: r, lookback=10, block_rows=5)


def test_running_equals_whole_window(small_blocks, walk, walk_df):
    holes = walk_df.withColumn("h", F.when(F.pmod(F.xxhash64("date", "ticker"), F.lit(4)) == 0, F.col("close")))
    spec = {"s": ("sum", "close"), "m": ("max", "low"), "l": ("last", "h"), "n": ("next", "h"), "f": ("first", "h")}
    got = frame(R.running(numbered(holes), ["ticker"], spec))
    want = frame(holes).groupby("ticker")
    same(got["s"], want["close"].cumsum())
    same(got["m"], want["low"].cummax())
    same(got["l"], want["h"].ffill())
    same(got["n"], want["h"].bfill())
    same(got["f"], want["h"].transform("first"))


def test_running_over_all_rows_without_a_key(small_blocks, walk_df):
    rows = R.with_position(walk_df.select("date").distinct(), [], ["date"])
    got = frame(R.running(rows, [], {"c": ("sum", "1")}), ["date"])
    assert got["c"].tolist() == list(range(1, len(got) + 1))


@pytest.mark.parametrize("n", [1, 4, 50, 5000])
def test_tail_keeps_exactly_the_newest_rows(small_blocks, walk, walk_df, n):
    got = frame(R.tail(walk_df, ["ticker"], ["date"], n))
    want = walk.sort_values(["ticker", "date"]).groupby("ticker").tail(n).reset_index(drop=True)
    assert got[["ticker", "date"]].values.tolist() == want[["ticker", "date"]].values.tolist()


def test_tail_when_one_slot_holds_everything(walk_df):
    got = R.tail(walk_df.withColumn("k", F.lit(1)), ["k"], ["date", "ticker"], 10, slot_width=10**6)
    want = sorted((r.date, r.ticker) for r in walk_df.collect())[-10:]
    assert sorted((r.date, r.ticker) for r in got.collect()) == want


def test_tail_needs_a_bound_for_a_column_limit(walk_df):
    with pytest.raises(ValueError):
        R.tail(walk_df, ["ticker"], ["date"], F.lit(3))


def test_value_ranks_with_ties_and_outliers(small_blocks, spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.round(rng.normal(0, 1, 400), 1), [1e9, -1e9, 0.0, 0.0]])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 5.0)] * 3, "k string, v double")
    got = {(r.k, r.v): (r["count"], r.smaller, r.total) for r in R.value_ranks(df, ["k"], "v").collect()}
    for v in set(values):
        assert got[("a", v)] == ((values == v).sum(), (values < v).sum(), len(values))
    assert got[("b", 5.0)] == (3, 0, 3)


def test_quantiles_are_exact(small_blocks, walk, walk_df):
    got = frame(R.quantiles(walk_df, ["ticker"], "close", {"q1": 0.25, "q2": 0.5, "q9": 0.9}), ["ticker"])
    want = walk.groupby("ticker")["close"].quantile([0.25, 0.5, 0.9]).unstack()
    same(got[["q1", "q2", "q9"]], want)


def test_align_and_fill(small_blocks, walk, walk_df):
    got = frame(clean.fill_chain(clean.align(walk_df, chunk=11), ["close"]))
    wide = walk.pivot(index="date", columns="ticker", values="close").ffill().bfill()
    want = wide.unstack().reset_index(name="close").sort_values(["ticker", "date"])
    assert len(got) == len(want)
    same(got["close"], want["close"])


def test_gaps_and_business_days(spark):
    rows = [("a", d) for d in ("2024-01-04", "2024-01-05", "2024-01-08", "2024-01-11", "2024-01-22")]
    df = spark.createDataFrame(rows, "ticker string, d string").select("ticker", F.to_date("d").alias("date"))
    assert sorted(r.days for r in clean.gaps(df).collect()) == [3, 3, 11]
    # Friday to Monday is one business day, Thursday to the second Monday after is seven.
    assert sorted(r.days for r in clean.gaps(df, business_days=True).collect()) == [3, 7]


def test_suppression_keeps_the_first_of_equal_neighbours(small_blocks, spark):
    rows = [("a", i, "t%d" % (i // 3), float(i // 6)) for i in range(60)]
    df = spark.createDataFrame(rows, "ticker string, offset bigint, timestamp string, close double")
    assert sorted(r.offset for r in clean.suppress_unchanged(df).collect()) == list(range(0, 60, 3))


def test_ordered_rank_equals_a_global_sort(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.permutation(5000), "v": rng.integers(0, 50, 5000).astype(float)})
    pdf.loc[::97, "v"] = np.nan
    df = spark.createDataFrame([(int(k), None if v != v else float(v)) for k, v in pdf.values], "k long, v double")
    got = R.ordered_rank(df, [F.col("v").desc_nulls_last(), F.col("k")]).toPandas().sort_values("rank")
    want = pdf.sort_values(["v", "k"], ascending=[False, True], na_position="last")
    assert got["k"].tolist() == want["k"].tolist() and got["rank"].tolist() == list(range(1, 5001))
    assert R.ordered_rank(df.limit(0), [F.col("k")]).count() == 0
