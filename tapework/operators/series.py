"""Ordered operators that never put a whole series into one task.

A window partitioned by instrument alone runs a series in a single task, however long it is.
Everything here works on bounded pieces instead:

* ``with_position`` numbers the rows of a series. Rows are counted per (key, time slot), the
  counts are summed along the slots, and ``row_number`` only runs inside one slot.
* ``tiled`` evaluates look-back and look-ahead windows per (key, block of positions); the rows a
  neighbouring block needs are copied to it, so the result equals the unpartitioned window.
* ``running`` evaluates cumulative sums, extremes and fills: a local pass inside each block plus
  a carry taken from the totals of the earlier blocks.
* ``value_ranks`` does the same for an ordering by value (quantiles, rank correlation).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapework.session import materialize

POS = "_pos"
ROWS = "_rows"
BLOCK = "_block"
SLOT = "_slot"

# Rows per block. Windows copy edge rows between blocks, so their blocks hold at least EDGE_SHARE
# times the edge; running columns copy nothing and use long blocks, which keeps the table of block
# totals (rows / RUN_ROWS per key) small enough to be summed along in one task.
BLOCK_ROWS = 1024
EDGE_SHARE = 16
RUN_ROWS = 65536
SLOT_DAYS = 512
SLOT_SECONDS = 600
SLOT_INTEGERS = 65536
VALUE_BINS = 1024
SALTS = 32


def time_slot(df: DataFrame, column: str, width: int | None = None) -> Column:
    """Coarse, order-preserving slot of an ordering column (date, timestamp or integer)."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        value, default = F.unix_date(column), SLOT_DAYS
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value, default = F.unix_seconds(F.col(column).cast("timestamp")), SLOT_SECONDS
    else:
        value, default = F.col(column), SLOT_INTEGERS
    return F.floor(value / F.lit(width or default)).cast("bigint")


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  slot: Column | None = None, slot_width: int | None = None) -> DataFrame:
    """Add the zero-based position of each row in its series and the length of the series.

    ``order`` must be unique within a key; its first column defines the slots.
    """
    keys = list(keys)
    slotted = df.withColumn(SLOT, time_slot(df, order[0], slot_width) if slot is None else slot)
    counts = slotted.groupBy(*keys, SLOT).agg(F.count(F.lit(1)).alias("_c"))
    along = Window.partitionBy(*keys).orderBy(SLOT)
    offsets = counts.select(
        *keys, SLOT,
        F.coalesce(F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .cast("bigint").alias("_before"),
        F.sum("_c").over(Window.partitionBy(*keys)).cast("bigint").alias(ROWS),
    )
    inside = Window.partitionBy(*keys, SLOT).orderBy(*order)
    return (
        slotted.join(offsets, [*keys, SLOT])
        .withColumn(POS, F.col("_before") + F.row_number().over(inside) - F.lit(1))
        .drop(SLOT, "_before")
    )


def tiled(df: DataFrame, keys: Sequence[str], build: Callable[[DataFrame, WindowSpec], DataFrame],
          lookback: int = 0, lookahead: int = 0, block_rows: int | None = None,
          keep_block: bool = False) -> DataFrame:
    """Evaluate ``build(rows, window)`` per block of positions, with copied edge rows.

    The window is ordered by position. ``lookback``/``lookahead`` give how many rows before and
    after a row its result may depend on; they also bound the number of copied rows per block.
    ``keep_block`` leaves the block column, so a following ``running`` needs no second shuffle.
    """
    block_rows = block_rows or max(BLOCK_ROWS, EDGE_SHARE * max(lookback, lookahead))
    if block_rows < max(lookback, lookahead):
        raise ValueError("a block must hold at least as many rows as its neighbours need")
    home = F.expr(f"{POS} div {block_rows}")
    inside = F.pmod(F.col(POS), F.lit(block_rows))
    copies = [home]
    if lookback:
        copies.append(F.when((inside >= block_rows - lookback)
                             & ((home + 1) * block_rows < F.col(ROWS)), home + 1))
    if lookahead:
        copies.append(F.when((inside < lookahead) & (home > 0), home - 1))
    rows = df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*copies))) if len(copies) > 1 else home)
    window = Window.partitionBy(*keys, BLOCK).orderBy(POS)
    result = build(rows, window)
    if len(copies) > 1:
        result = result.where(home == F.col(BLOCK))
    return result if keep_block else result.drop(BLOCK)


_EARLIER = (Window.unboundedPreceding, -1)


def running(df: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, str]],
            block_rows: int | None = None) -> DataFrame:
    """Cumulative columns over positions: ``{name: (kind, SQL expression)}``.

    Kinds: ``sum``, ``max``, ``last`` (latest non-null so far), ``next`` (next non-null), ``first``
    (first non-null of the whole series). Each is a local pass inside a block combined with a carry
    from the other blocks; the carry windows run over one row per block, not over the rows.
    """
    keys, block_rows = list(keys), block_rows or RUN_ROWS
    blocked = df if BLOCK in df.columns else df.withColumn(BLOCK, F.expr(f"{POS} div {block_rows}"))
    part = "".join(f"`{k}`, " for k in keys)
    whole = f"partition by {part.rstrip(', ')}" if keys else ""
    earlier = "rows between unbounded preceding and 1 preceding"
    so_far = "rows between unbounded preceding and current row"
    # Looking forward is looking back in reverse order: frames that end at the last row are
    # re-evaluated for every row, running frames are not.
    local = {way: f"(partition by {part}{BLOCK} order by {POS} {way} {so_far})" for way in ("asc", "desc")}
    blocks = {way: f"({whole} order by {BLOCK} {way} {earlier})" for way in ("asc", "desc")}
    # kind: (total of a block, carry into a block, local value combined with the carry `c`).
    forms = {
        "sum": ("sum({v})", f"coalesce(sum({{t}}) over {blocks['asc']}, 0)", f"sum({{v}}) over {local['asc']} + {{c}}"),
        "max": ("max({v})", f"max({{t}}) over {blocks['asc']}", f"greatest(max({{v}}) over {local['asc']}, {{c}})"),
        "last": (f"max_by({{v}}, {POS}) filter (where {{v}} is not null)",
                 f"last({{t}}) ignore nulls over {blocks['asc']}",
                 f"coalesce(last({{v}}) ignore nulls over {local['asc']}, {{c}})"),
        "next": (f"min_by({{v}}, {POS}) filter (where {{v}} is not null)",
                 f"last({{t}}) ignore nulls over {blocks['desc']}",
                 f"coalesce(last({{v}}) ignore nulls over {local['desc']}, {{c}})"),
        "first": (f"min_by({{v}}, {POS}) filter (where {{v}} is not null)",
                  f"min_by({{t}}, if({{t}} is null, null, {BLOCK})) over ({whole})", "{c}"),
    }
    totals, carries, combined = [], [], []
    for name, (kind, value) in columns.items():
        names = {"v": f"({value})", "t": f"`_t_{name}`", "c": f"`_c_{name}`"}
        total, carry, column = (form.format(**names) for form in forms[kind])
        totals.append(F.expr(f"{total} as {names['t']}"))
        carries.append(F.expr(f"{carry} as {names['c']}"))
        combined.append(F.expr(f"{column} as `{name}`"))
    carry = blocked.groupBy(*keys, BLOCK).agg(*totals).select(*keys, BLOCK, *carries)
    kept = [c for c in df.columns if c not in columns and c != BLOCK]
    return blocked.join(carry, [*keys, BLOCK]).select(*kept, *combined)


def tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: Column | int, most: int | None = None,
         slot_width: int | None = None) -> DataFrame:
    """Last ``limit`` rows of each series; ``most`` bounds a limit that is a column.

    Slots that lie wholly before the tail are discarded from their counts alone. What is left is
    ranked in salted parts first, so even a slot with very many rows reaches the final ranking as
    at most ``SALTS * most`` rows. A limit above ``most`` raises.
    """
    keys = list(keys)
    most = limit if isinstance(limit, int) else most
    if most is None:
        raise ValueError("a limit column needs an upper bound")
    limit = F.lit(limit) if isinstance(limit, int) else F.when(limit > most, F.raise_error(F.concat(
        F.lit(f"a limit is above the bound of {most}: "), limit.cast("string"))).cast("int")).otherwise(limit)
    slotted = df.withColumn(SLOT, time_slot(df, order[0], slot_width)).withColumn("_limit", limit)
    after = Window.partitionBy(*keys).orderBy(F.col(SLOT).desc()).rowsBetween(*_EARLIER)
    needed = (
        slotted.groupBy(*keys, SLOT).agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_after", F.coalesce(F.sum("_c").over(after), F.lit(0)))
        .where(F.col("_after") < most).select(*keys, SLOT, "_after")
    )
    newest = [F.col(c).desc() for c in order]
    parts = Window.partitionBy(*keys, SLOT, "_salt").orderBy(*newest)
    inside = Window.partitionBy(*keys, SLOT).orderBy(*newest)
    return (
        slotted.join(needed, [*keys, SLOT])
        .withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        .withColumn("_rank", F.row_number().over(parts)).where(F.col("_rank") <= most)
        .withColumn("_rank", F.row_number().over(inside) + F.col("_after")).where(F.col("_rank") <= F.col("_limit"))
        .drop(SLOT, "_limit", "_after", "_rank", "_salt")
    )


def ordered_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 along ``order`` without one task that sorts them all: rows are dealt out
    by ranges of the order, numbered inside a range, and lifted by the sizes of the ranges before it.
    The driver reads one count per range. ``order`` should be unique."""
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():
        before += [F.lit(r["_range"]), F.lit(total).cast("bigint")]
        total += r["count"]
    lift = F.element_at(F.create_map(*before), F.col("_range")) if before else F.lit(0).cast("bigint")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn(name, (lift + inside).cast("int")).drop("_range")


def _bin(value: str, low: str, high: str, bins: int) -> Column:
    width = F.nullif(F.col(high) - F.col(low), F.lit(0.0))
    return F.coalesce(F.floor((F.col(value) - F.col(low)) / width * bins), F.lit(0)).cast("bigint")


def value_ranks(df: DataFrame, keys: Sequence[str], column: str, bins: int | None = None) -> DataFrame:
    """One row per (key, distinct value): its count and the number of smaller values.

    Equal values are merged before the shuffle. Values are spread over equal-width bins of the
    key's range and then over equal-width parts of each bin's own range, so a few far-out values
    do not push all others into one task. The running count inside a part is lifted by the totals
    of the lower parts. Bins depend on minima and maxima only, which do not change between runs.
    """
    keys, bins = list(keys), bins or VALUE_BINS
    counted = (df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v"))
               .agg(F.count(F.lit(1)).alias("_n")))
    span = counted.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    coarse = counted.join(span, keys).select(*keys, "_v", "_n", _bin("_v", "_lo", "_hi", bins).alias("_bin"))
    inner = coarse.groupBy(*keys, "_bin").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    binned = coarse.join(inner, [*keys, "_bin"]).select(
        *keys, "_v", "_n", "_bin", _bin("_v", "_lo", "_hi", bins).alias("_part"))
    along = Window.partitionBy(*keys).orderBy("_bin", "_part").rowsBetween(*_EARLIER)
    lower = (
        binned.groupBy(*keys, "_bin", "_part").agg(F.sum("_n").alias("_t"))
        .select(*keys, "_bin", "_part", F.coalesce(F.sum("_t").over(along), F.lit(0)).alias("_below"),
                F.sum("_t").over(Window.partitionBy(*keys)).alias("total"))
    )
    inside = Window.partitionBy(*keys, "_bin", "_part").orderBy("_v").rowsBetween(*_EARLIER)
    return binned.join(lower, [*keys, "_bin", "_part"]).select(
        *keys, F.col("_v").alias(column), F.col("_n").alias("count"),
        (F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("smaller"), "total",
    )


def quantiles(df: DataFrame, keys: Sequence[str], column: str, names: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key: ``{output name: probability}``."""
    ranked = value_ranks(df, keys, column)
    value = F.col(column)

    def at(rank: Column) -> Column:
        hit = (F.col("smaller") <= rank) & (rank < F.col("smaller") + F.col("count"))
        return F.max(F.when(hit, value))

    picks, outs = [], []
    for name, p in names.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        low = F.floor(place)
        picks += [at(low).alias(f"_l_{name}"), at(F.least(low + 1, F.col("total") - 1)).alias(f"_h_{name}"),
                  F.max(place - low).alias(f"_f_{name}")]
        outs.append((F.col(f"_l_{name}") + (F.col(f"_h_{name}") - F.col(f"_l_{name}")) * F.col(f"_f_{name}"))
                    .alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *outs)
