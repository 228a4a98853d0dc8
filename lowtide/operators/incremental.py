"""The feature panel carried forward day by day.

Every feature of a bar follows from a bounded *state* of its ticker: the last 252 lows and highs, the
last 200 closes, the last 30 volumes, the last 14 moves, and the trailing sums, which change by what
enters and what leaves.  A new day therefore reads one day of bars and one partition of state, and
costs the same however long the history is:

    {path}/bars/price_date=<day>/       bars as they were appended
    {path}/state/run_date=<day>/        the state of every ticker after that day
    {path}/features/run_date=<day>/     the features of that day's bars

Sums run over integer ticks, so the features are those of ``indicators.feature_panel`` to the bit.
A day that is run again replaces its own partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lowtide.operators.indicators import DAY_BITS, DAY_SPAN, PRICE_SCALE, YEAR_ROWS
from lowtide.operators.merge import replace_partitions

BAR = ["price_date", "open", "high", "low", "close", "volume"]
#: arrays of the state and their lengths, oldest first
KEPT = {"cs": 200, "vs": 30, "gains": 14, "losses": 14, "ranges": 14, "lows": YEAR_ROWS, "highs": YEAR_ROWS}
#: trailing sums: the array they run over and their rows
SUMS = {"c50": ("cs", 50), "c200": ("cs", 200), "v20": ("vs", 20), "v30": ("vs", 30), "gain": ("gains", 14), "loss": ("losses", 14), "tr": ("ranges", 14)}


def _tick(price: Column) -> Column:
    return F.floor(price * PRICE_SCALE + 0.5)


def _values(bar: Column, before: Column) -> dict[str, Column]:
    """What a bar adds to each array, given the close tick before it (NULL for a first bar)."""
    close, high, low = (_tick(bar[c]) for c in ("close", "high", "low"))
    zero = F.lit(0).cast("bigint")
    change = F.coalesce(close - before, zero)
    true_range = F.greatest(high - low, F.abs(high - before), F.abs(low - before))
    return {
        "cs": close,
        "vs": F.coalesce(bar["volume"].cast("bigint"), zero),
        "gains": F.greatest(change, zero),
        "losses": F.greatest(-change, zero),
        "ranges": F.coalesce(true_range, zero),
        # low and day in one integer: its minimum is the lowest low at its earliest day
        "lows": low * DAY_SPAN + (F.unix_date(bar["price_date"]) + DAY_SPAN // 2),
        "highs": high,
    }


def _newest(values: Column, rows: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - rows + 1, F.lit(1)), rows)


def state_of(bars: DataFrame) -> DataFrame:
    """The state of every ticker after all of these bars, one shuffle and at most 252 rows a ticker."""
    by_day = Window.partitionBy("ticker").orderBy("price_date")
    before = F.lag(_tick(F.col("close"))).over(by_day)
    rows = bars.select(
        "ticker",
        F.struct(*BAR).alias("bar"),
        before.alias("_before"),
        F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("price_date"))).alias("_back"),
        F.count("*").over(Window.partitionBy("ticker")).alias("n_bars"),
    ).filter(F.col("_back") <= YEAR_ROWS)
    rows = rows.select("ticker", "bar", "_back", "n_bars", F.struct(*[v.alias(k) for k, v in _values(F.col("bar"), F.col("_before")).items()]).alias("_v"))
    grouped = rows.groupBy("ticker").agg(
        F.max("n_bars").alias("n_bars"),
        F.max_by("bar", F.col("bar.price_date")).alias("bar"),
        F.sort_array(F.collect_list(F.struct(F.col("bar.price_date").alias("day"), "_v"))).alias("_all"),
    )
    # an array drops no element for being NULL, so places stay those of the bars
    arrays = {k: _newest(F.col("_all")["_v"][k], n) for k, n in KEPT.items()}
    state = grouped.select("ticker", "n_bars", "bar", *[a.alias(k) for k, a in arrays.items()])
    zero = F.lit(0).cast("bigint")
    total = lambda k, n: F.aggregate(_newest(F.col(k), n), zero, lambda a, b: a + b)
    return state.withColumns({name: total(k, n) for name, (k, n) in SUMS.items()})


def advance(state: DataFrame, day_bars: DataFrame) -> DataFrame:
    """The state after one more day; tickers without a bar that day keep theirs."""
    today = day_bars.select("ticker", F.struct(*BAR).alias("_bar"))
    joined = state.join(today, "ticker", "full_outer")
    fresh, known = F.col("_bar").isNotNull(), F.col("n_bars").isNotNull()
    added = _values(F.col("_bar"), F.element_at("cs", -1))
    old = {k: F.coalesce(F.col(k), F.array().cast("array<bigint>")) for k in KEPT}
    columns: dict[str, Column] = {
        "n_bars": F.when(fresh, F.coalesce("n_bars", F.lit(0)) + 1).otherwise(F.col("n_bars")).cast("bigint"),
        "bar": F.when(fresh, F.col("_bar")).otherwise(F.col("bar")),
    }
    for k, n in KEPT.items():
        columns[k] = F.when(fresh, _newest(F.concat(old[k], F.array(added[k])), n)).otherwise(F.col(k))
    for name, (k, n) in SUMS.items():
        leaving = F.when(F.size(old[k]) >= n, F.element_at(old[k], -n)).otherwise(0)
        grown = F.when(known, F.col(name)).otherwise(0) + added[k] - leaving
        columns[name] = F.when(fresh, grown).otherwise(F.col(name)).cast("bigint")
    return joined.select("ticker", *[c.alias(name) for name, c in columns.items()])


def features_of(state: DataFrame) -> DataFrame:
    """The newest bar of every ticker with its trailing features, from the state alone."""
    rows = state.select("*", "bar.*")
    n, close = F.col("n_bars"), F.element_at("cs", -1)
    scale = float(PRICE_SCALE)
    sum50 = F.when(n >= 50, F.col("c50")).otherwise(close * 50)
    sum200 = F.when(n >= 200, F.col("c200")).otherwise(close * 200)
    rows30 = F.least(n, F.lit(30))
    low = F.array_min("lows")
    low_day = F.pmod(low, F.lit(DAY_SPAN)) - DAY_SPAN // 2
    volume = F.element_at("vs", -1)
    return rows.select(
        "ticker",
        *BAR,
        "n_bars",
        F.col("close").alias("price"),
        (F.shiftright(low, DAY_BITS) / F.lit(scale)).alias("low_52w"),
        (F.array_max("highs") / F.lit(scale)).alias("high_52w"),
        F.date_from_unix_date(low_day.cast("int")).alias("low_date"),
        (F.unix_date("price_date") - low_day).cast("bigint").alias("days_since_low"),
        (F.col("v30") / rows30).alias("avg_volume_30d"),
        F.when(F.col("v30") > 0, volume * rows30 / F.col("v30")).otherwise(0.0).alias("rvol"),
        F.when(n >= 20, F.col("v20") / F.lit(20.0)).otherwise(volume.cast("double")).alias("avg_volume_20d"),
        F.when(n <= 14, 50.0).otherwise(F.try_divide(F.lit(100.0) * F.col("gain"), F.col("gain") + F.col("loss"))).alias("rsi"),
        F.when(n >= 50, F.col("c50") / F.lit(50 * scale)).otherwise(F.col("close")).alias("sma50"),
        F.when(n >= 200, F.col("c200") / F.lit(200 * scale)).otherwise(F.col("close")).alias("sma200"),
        F.when(sum50 > 0, close * 50 / sum50).otherwise(1.0).alias("price_vs_sma50_pct"),
        F.when(sum200 > 0, sum50 * 4 / sum200).otherwise(1.0).alias("sma50_vs_sma200_pct"),
        F.when(n <= 14, 0.05).otherwise(F.when(close > 0, F.col("tr") / (close * F.lit(14.0))).otherwise(0.0)).alias("atr_pct"),
    )


# --- tables --------------------------------------------------------------------------------------


def append_bars(bars: DataFrame, path: str) -> None:
    """Add bars to the table of bars, a partition a day; a day that is there is replaced."""
    replace_partitions(bars.select("ticker", *BAR), f"{path}/bars", ["price_date"])


def bars_of_day(spark: SparkSession, path: str, day) -> DataFrame:
    """One day's partition of the table of bars."""
    rows = spark.read.parquet(f"{path}/bars").filter(F.col("price_date") == F.lit(day).cast("date"))
    return rows.select("ticker", *BAR)


def state_at(spark: SparkSession, path: str, day) -> DataFrame:
    """The state after a run."""
    return spark.read.parquet(f"{path}/state").filter(F.col("run_date") == F.lit(day).cast("date")).drop("run_date")


def start(bars: DataFrame, panel: DataFrame, path: str, day) -> None:
    """Begin the tables from a history up to ``day`` whose features (``feature_panel``) are given."""
    stamp = F.lit(day).cast("date")
    replace_partitions(state_of(bars).withColumn("run_date", stamp), f"{path}/state", ["run_date"])
    replace_partitions(panel.withColumn("run_date", stamp), f"{path}/features", ["run_date"])


def next_state(spark: SparkSession, path: str, before, day) -> DataFrame:
    """The state after ``day``, from the run ``before`` and the bars of the day."""
    return advance(state_at(spark, path, before), bars_of_day(spark, path, day))


def run_day(spark: SparkSession, path: str, before, day) -> None:
    """One day: state partition, then features of the day's bars."""
    stamp = F.lit(day).cast("date")
    replace_partitions(next_state(spark, path, before, day).withColumn("run_date", stamp), f"{path}/state", ["run_date"])
    found = features_of(state_at(spark, path, day)).filter(F.col("price_date") == stamp)
    replace_partitions(found.withColumn("run_date", stamp), f"{path}/features", ["run_date"])


def read_features(spark: SparkSession, path: str, first=None) -> DataFrame:
    """Features of all bars, or of the runs from ``first`` on."""
    rows = spark.read.parquet(f"{path}/features")
    if first is not None:
        rows = rows.filter(F.col("run_date") >= F.lit(first).cast("date"))
    return rows.drop("run_date")
