"""Readers and writers of bar, calendar, spread and trade files.

Text comes in as strings without quoting and is cleaned by column expressions; whatever does not
parse becomes null. NaN text becomes null as well, so that comparisons with it are not true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import CalendarOptions, attach_calendar
from ..schema import NEWS, OHLC, PRICE_STRUCTURE, VOLREGIME

# Time formats of exports, in the order in which they are tried.
TIME_FORMATS = ["yyyyMMdd HH:mm", "yyyyMMdd HHmm", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm"]
MORE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]
ENCODINGS = ["UTF-8", "UTF-16", "windows-1252", "ISO-8859-1"]
#: Share of rows that a format has to parse.
ENOUGH = 0.99
CALENDAR_NUMBERS = ["event_id", "importance", "sector", "event_type", "unit", "multiplier", "impact_type", "revision", "actual", "forecast", "previous", "revised_previous"]
# Headers under which trade lists come, in lower case with underscores for spaces.
TRADE_ALIASES = {
    "entry_time": ["entry_time", "open_time", "time_open", "opentime"], "exit_time": ["exit_time", "close_time", "time_close", "closetime"],
    "entry_price": ["entry_price", "open_price", "price_open", "openprice"], "exit_price": ["exit_price", "close_price", "price_close", "closeprice"],
}


def clean(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit('"'), F.lit("")))


def number(c: Column, kind: str = "float") -> Column:
    x = clean(c).try_cast(kind)
    return F.when(~F.isnan(x), x)


def moment(c: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(clean(c), F.lit(f)) for f in formats])


def read_text_table(spark: SparkSession, path: str, encodings: list[str] = ENCODINGS) -> DataFrame:
    """All columns as strings, in file order (_seq), by the first encoding whose header has no foreign characters.

    Quotes are ordinary characters and are stripped later, so that one that is never closed costs a
    value at most; rows that are too long or short are kept as far as they go."""
    for encoding in encodings:
        options = {"header": True, "inferSchema": False, "quote": "", "encoding": encoding, "mode": "PERMISSIVE"}
        if encoding.startswith("UTF-16"):
            options["multiLine"] = True  # lines are found after decoding, in one task a file
        try:
            df = spark.read.options(**options).csv(path)
        except Exception as e:  # an encoding that Spark does not take
            if "encoding" not in str(e).lower() and "charset" not in str(e).lower():
                raise
            continue
        names = [c.replace('"', "").strip().lstrip("﻿").rstrip("\r") for c in df.columns]
        if all(n.isprintable() and "�" not in n for n in names):
            return df.toDF(*names).withColumn("_seq", F.monotonically_increasing_id())
    raise ValueError(f"malformed content in {path}")


def parse_time(df: DataFrame, column: str = "time", formats: list[str] = TIME_FORMATS) -> DataFrame:
    """Replace a text column by timestamps (no time zone); rows that do not parse go, too many of them are an error.

    The first format that parses enough of all rows is taken, else each row's own."""
    shares = df.agg(*[F.avg(moment(F.col(column), [f]).isNotNull().cast("double")).alias(f"s{i}") for i, f in enumerate(formats)], F.avg(moment(F.col(column), formats + MORE_FORMATS).isNotNull().cast("double")).alias("every")).first()
    chosen = next(([f] for i, f in enumerate(formats) if (shares[f"s{i}"] or 0) >= ENOUGH), formats + MORE_FORMATS)
    if shares["every"] is not None and shares["every"] < ENOUGH:
        raise ValueError(f"{column} does not parse in {1 - shares['every']:.1%} of rows")
    return df.withColumn(column, moment(F.col(column), chosen).cast("timestamp_ntz")).filter(F.col(column).isNotNull())


def keep_one(df: DataFrame, by: list[str], last: bool) -> DataFrame:
    """The last (or first) row in file order for each key."""
    w = Window.partitionBy(*by).orderBy(F.col("_seq").desc() if last else F.col("_seq"))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def read_bars(spark: SparkSession, path: str, symbol: str, timeframe: str) -> DataFrame:
    """Bars of an export: keys, time, bar_idx and every other column as a float; the last row of a repeated time stays."""
    df = read_text_table(spark, path)
    if "time" not in df.columns:
        raise ValueError("no column time")
    df = keep_one(parse_time(df), ["time"], last=True)
    rest = [c for c in df.columns if c not in ("time", "_seq")]
    typed = df.select(F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), "time", *[number(F.col(c)).alias(c) for c in rest])
    w = Window.partitionBy("symbol", "timeframe")
    return sanitize_news(typed).withColumn("bar_idx", F.row_number().over(w.orderBy("time")) - 1).withColumn("n", F.count("*").over(w))


def validate_schema(bars: DataFrame) -> dict:
    """Custom column groups present, empty or missing (and what a group lacks), values out of range and nulls by column, all in one aggregation; never raises."""
    groups = {"volregime": VOLREGIME, "ps": PRICE_STRUCTURE, "news": NEWS}
    have = [c for c in bars.columns if c not in ("symbol", "timeframe", "time")]
    limits = {"volregime_regime": F.col("volregime_regime").isin(0, 1, 2), "volregime_atr_pctl": F.col("volregime_atr_pctl").between(0, 100), "ps_gap_fill_pct": F.col("ps_gap_fill_pct").between(0, 100)}
    aggs = [F.count(c).alias(f"n_{c}") for c in have] + [F.count_if(~ok).alias(f"bad_{c}") for c, ok in limits.items() if c in have]
    row = bars.agg(F.count("*").alias("rows"), *aggs).first()
    state = lambda cols: "missing" if not set(cols) & set(have) else "empty" if not any(row[f"n_{c}"] for c in cols if c in have) else "present"
    return {
        "groups": {g: state(cols) for g, cols in groups.items()}, "absent": {g: [c for c in cols if c not in have] for g, cols in groups.items() if state(cols) != "missing"}, "missing_ohlc": [c for c in OHLC if c not in have],
        "out_of_range": {c: row[f"bad_{c}"] for c in limits if c in have}, "nulls": {c: row["rows"] - row[f"n_{c}"] for c in have},
    }


def sanitize_news(bars: DataFrame) -> DataFrame:
    """Rows without a last or next event lose all news values, unless every row is such; an event at the bar itself becomes the next one."""
    if not set(NEWS) <= set(bars.columns):
        return bars
    to, nxt, since, last, surprise, _, count = NEWS
    open_ = F.col(since).isNull() | F.col(to).isNull()
    some = F.count_if(~open_).over(Window.partitionBy("symbol", "timeframe")) > 0
    df = bars.withColumn("_gone", open_ & some)
    df = df.withColumns({c: F.when(~F.col("_gone"), F.col(c)) for c in NEWS}).withColumn("_at", F.coalesce(F.col(since) == 0, F.lit(False)))
    at = F.col("_at")
    return df.withColumns(
        {
            to: F.when(at, F.lit(0.0).cast("float")).otherwise(F.col(to)), nxt: F.when(at, F.col(last)).otherwise(F.col(nxt)),
            count: F.when(at, (F.col(count) + 1).cast("float")).otherwise(F.col(count)),
            since: F.when(~at, F.col(since)), last: F.when(~at, F.col(last)), surprise: F.when(~at, F.col(surprise)),
        }
    ).drop("_gone", "_at")


def write_bars(bars: DataFrame, folder: str, compression: str = "zstd") -> None:
    """Parquet by symbol and timeframe, so that a run reads its own part only."""
    bars.write.mode("overwrite").option("compression", compression).partitionBy("symbol", "timeframe").parquet(folder)


def load_bars(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Stored bars, doubles as floats; columns that are not there are skipped, and only those asked for are read."""
    df = spark.read.parquet(folder)
    keys = [c for c in ("symbol", "timeframe", "time", "bar_idx", "n") if c in df.columns]
    names = keys + [c for c in (columns if columns is not None else df.columns) if c in df.columns and c not in keys]
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("float").alias(c) if kinds[c] == "double" else F.col(c) for c in names])


def news_repairs(bars: DataFrame) -> dict[str, int]:
    """Rows that sanitize_news changes: boundary_rows (an event at the bar itself) and uncovered_rows; of bars as they were read."""
    if not set(NEWS) <= set(bars.columns):
        return {"boundary_rows": 0, "uncovered_rows": 0}
    open_ = F.col(NEWS[2]).isNull() | F.col(NEWS[0]).isNull()
    row = bars.agg(F.count("*").alias("n"), F.count_if(open_).alias("open"), F.count_if(~open_ & (F.col(NEWS[2]) == 0)).alias("at")).first()
    return {"boundary_rows": row["at"], "uncovered_rows": row["open"] if row["open"] < row["n"] else 0}


def ingest(spark: SparkSession, path: str, folder: str, symbol: str, timeframe: str, compression: str = "zstd", calendar: str | None = None, options: CalendarOptions = CalendarOptions(), currencies: list[str] | None = None) -> DataFrame:
    """Read an export, with the cal_ columns of a calendar file if one is given, store it, and return what is stored."""
    bars = read_bars(spark, path, symbol, timeframe)
    if calendar is not None:
        bars = attach_calendar(bars, read_calendar(spark, calendar), symbol, timeframe, options, currencies)
    write_bars(bars, folder, compression)
    return load_bars(spark, folder)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar events: time_server, text columns, upper-case currency, numbers as doubles (absent ones null), exact repeats once."""
    df = read_text_table(spark, path)
    if missing := [c for c in ("time_server", "importance", "currency") if c not in df.columns]:
        raise ValueError(f"no column {missing[0]}")
    numbers = [(number(F.col(c), "double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in CALENDAR_NUMBERS]
    words = [clean(F.col(c)).alias(c) for c in ("country", "event_name") if c in df.columns]
    time = F.try_to_timestamp(clean(F.col("time_server")), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = df.select(time.cast("timestamp_ntz").alias("time"), time.cast("long").alias("t"), F.upper(clean(F.col("currency"))).alias("currency"), *numbers, *words)
    return out.filter("time IS NOT NULL").dropDuplicates()


def read_spreads(spark: SparkSession, path: str) -> DataFrame:
    """time, spread (points); the first row of a repeated time stays."""
    df = read_text_table(spark, path)
    df = df.toDF(*[c.lower() for c in df.columns])
    return keep_one(parse_time(df), ["time"], last=False).select("time", number(F.col("spread"), "double").alias("spread"))


def read_reference_trades(spark: SparkSession, path: str) -> DataFrame:
    """entry_time, exit_time, entry_price, exit_price under any of their header aliases."""
    df = read_text_table(spark, path)
    lower = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    found = {}
    for name, aliases in TRADE_ALIASES.items():
        hit = next((lower[a] for a in aliases if a in lower), None)
        if hit is None:
            raise ValueError(f"no column for {name}")
        found[name] = f"`{hit}`"
    formats = TIME_FORMATS + MORE_FORMATS
    out = df.select(*[(moment(F.col(c), formats).cast("timestamp_ntz") if n.endswith("time") else number(F.col(c), "double")).alias(n) for n, c in found.items()])
    return out.filter("entry_time IS NOT NULL")


def write_results(df: DataFrame, folder: str, order: list[Column]) -> None:
    """A result table as one sorted CSV with a header (also without rows). Results have a row for each condition, not for each bar."""
    flat = df.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unfinished(keys: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Keys of a stage that its stored table does not have yet: what a resumed run still has to do."""
    return keys.join(done.select(*by).distinct(), by, "left_anti")
