"""Readers and writers, and the derivation of OHLC bars from trade-like tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspan.sources.stored import stored

BAR_SCHEMA = "series_id string, dt date, open double, high double, low double, close double"
FORECAST_SCHEMA = "series_id string, dt date, model string, actual double, forecast double"
CALENDAR_SCHEMA = "event_date date, source string"


def read_bars(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """OHLC bars with the declared schema (csv files have a header line); an empty table is an error."""
    bars = spark.read.format(format).option("header", True).schema(BAR_SCHEMA).load(path)
    if bars.isEmpty():
        raise ValueError(f"no bars in {path}")
    return bars


def read_csv(spark: SparkSession, path: str, schema: str, on_error: str = "null", header: bool = True) -> DataFrame:
    """CSV with a declared schema. A field that doesn't parse, or a line with too few or too many fields, gives nulls (``null``), ends the job (``fail``), or gives nulls and keeps the
    line in a column ``bad_line``, null elsewhere (``report``). The last two look at every field, whatever columns are used later."""
    reader = spark.read.option("header", header)
    if on_error == "null":
        return reader.schema(schema).csv(path)
    if on_error == "fail":
        found = reader.option("mode", "FAILFAST").schema(schema).csv(path)
    elif on_error == "report":
        found = reader.option("columnNameOfCorruptRecord", "bad_line").schema(f"{schema}, bad_line string").csv(path)
    else:
        raise ValueError(f"unknown way to meet errors: {on_error}")
    # Spark only parses fields that a plan uses; a filter that all rows pass uses them all.
    return found.filter(F.xxhash64("*") >= -(1 << 63))


def write_table(df: DataFrame, path: str, format: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(format).save(path)


def copy_table(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """Read with the schema and write again."""
    write_table(read_csv(spark, source, schema), target)


def flatten_columns(df: DataFrame) -> DataFrame:
    """Columns named by several levels (``Close.SPY``) under their first level in lower case; a ``ts`` loses its zone and becomes ``dt``."""
    out = df.select([F.col(f"`{c}`").alias(c.split(".")[0].lower()) for c in df.columns])
    return out.withColumn("dt", F.to_date("ts")).drop("ts") if "ts" in out.columns else out


def event_dates(spark: SparkSession, dates: list[str], source: str = "listed") -> DataFrame:
    """A calendar from a literal list of ISO dates."""
    return spark.createDataFrame([(d, source) for d in dates], "event_date string, source string").withColumn("event_date", F.to_date("event_date"))


def bars_from_trades(trades: DataFrame, series: Column, bucket: Column, price: Column, order: list[str], bucket_name: str = "dt", whole: str | None = None) -> DataFrame:
    """One bar per series and bucket: first, highest, lowest and last price by ``order``; ties go by price. ``whole`` names a series of all trades, put together from the others' bars.

    An aggregate of structs sorts its rows, so the trades are read twice instead: for the ends of ``order``'s first column and of the price, which a hash aggregate holds (written, one row a
    bar), and for the few trades at those ends, which alone are compared by the whole ``order``. Partial aggregates only, so any series may be large.
    """
    key, lead, at = ["series_id", bucket_name], F.col("_lead"), F.col("_at")
    rows = trades.select(series.alias("series_id"), bucket.alias(bucket_name), F.col(order[0]).alias("_lead"), F.struct(*order, price.alias("px")).alias("_at"))
    ends = stored(rows.groupBy(*key).agg(F.min(lead).alias("_least"), F.max(lead).alias("_most"), F.max(at["px"]).alias("high"), F.min(at["px"]).alias("low")))
    ends = ends.withColumnsRenamed({c: f"_{c}" for c in key})
    beside = rows.join(ends, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]))
    # A null comes before all values, so it may be the first trade, and the last where there is nothing else.
    edges = beside.filter(lead.isNull() | (lead == F.col("_least")) | (lead == F.col("_most")))
    found = edges.groupBy(*key).agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.max("high").alias("high"), F.min("low").alias("low"))
    if whole is not None:
        found = found.withColumn("series_id", F.explode(F.array(F.lit(whole), F.col("series_id"))))
        found = found.groupBy(*key).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("high").alias("high"), F.min("low").alias("low"))
    return found.select(*key, F.col("_first")["px"].alias("open"), "high", "low", F.col("_last")["px"].alias("close"))


def lineitem_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars of unit prices, for all lines (``ALL``) and by return flag."""
    lines = lineitem.filter("l_quantity > 0")
    return bars_from_trades(lines, F.col("l_returnflag"), F.to_date("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], whole="ALL")


def event_bars(events: DataFrame) -> DataFrame:
    """Hourly bars of event values by type."""
    return bars_from_trades(events, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), ["ts", "event_id"], "hour")


def order_calendar(orders: DataFrame, priority: str = "1-URGENT") -> DataFrame:
    """Each month's first date with an order of one priority, labelled by half-decade."""
    day = F.to_date("o_orderdate")
    found = orders.filter(F.col("o_orderpriority") == priority).groupBy(F.trunc(day, "month").alias("month")).agg(F.min(day).alias("event_date"))
    return found.select("event_date", F.when(F.year("event_date") < 1995, "early").otherwise("late").alias("source"))
