"""Readers of the domain's files; all lazy, with declared schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

FILING = T.StructType([T.StructField(n, T.StringType()) for n in ("ticker", "form", "filing_date", "accession_number")] + [T.StructField("sections", T.MapType(T.StringType(), T.StringType()))])
TICK = "t_local long, src string, msg string"
# Markers of a missing factor return.
MISSING = (-99.99, -999.0)


def require(df: DataFrame, *cols: str) -> DataFrame:
    """df, or an error that names the columns that it lacks."""
    if lacking := [c for c in cols if c not in df.columns]:
        raise ValueError(f"columns {lacking} are missing, there are {df.columns}")
    return df


def membership_csv(spark: SparkSession, path: str, renames: DataFrame | None = None, start: str | None = None) -> DataFrame:
    """``date, "A,B,C"`` snapshots -> (date, ticker), symbols normalised; renames (old, new, from_date) apply from their date on."""
    raw = spark.read.schema("date date, tickers string").option("header", True).csv(path)
    rows = raw.select("date", F.explode(F.split("tickers", ",")).alias("t")).select("date", S.ticker(F.col("t")).alias("ticker")).where("ticker <> ''")
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if renames is not None:
        r = renames.select(F.col("old").alias("ticker"), "new", "from_date")
        rows = rows.join(F.broadcast(r), "ticker", "left").select("date", F.when(F.col("from_date").isNull() | (F.col("date") >= F.col("from_date")), F.coalesce("new", "ticker")).otherwise(F.col("ticker")).alias("ticker"))
    return rows.distinct()


def check_cross_section(snapshots: DataFrame, lo: int, hi: int) -> DataFrame:
    """(date, n) of snapshots whose number of names is out of the band."""
    return snapshots.groupBy("date").agg(F.count_distinct("ticker").alias("n")).where(~F.col("n").between(lo, hi))


def filings_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per filing document: ticker, form, filing_date, digits-only accession, sections, text of all sections."""
    raw = spark.read.schema(FILING).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    text = F.array_join(F.map_values("sections"), "\n")
    return raw.select("ticker", "form", F.to_date("filing_date").alias("filing_date"), F.regexp_replace("accession_number", "[^0-9]", "").alias("accession"), "sections", text.alias("text")).where("ticker is not null")


def filing_names(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(ticker, date, accession) from names ``<ticker>/<form>_<date>_<accession>.json``; bad dates are left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{form}_*.json").load(path).select("path")
    part = lambda i: F.regexp_extract("path", r"([^/]+)/[^/_]+_([0-9-]+)_([0-9-]+)\.json$", i)
    return files.select(part(1).alias("ticker"), F.expr(r"try_to_date(regexp_extract(path, '([^/]+)/[^/_]+_([0-9-]+)_([0-9-]+)\\.json$', 2))").alias("date"), part(3).alias("accession")).where("date is not null")


def flag_item(filings: DataFrame, code: str = "2.02") -> DataFrame:
    """filings with has_item: the code occurs as an item anywhere in the text."""
    return filings.withColumn("has_item", F.array_contains(S.item_codes(F.col("text"), anchored=False), code))


def zero_item_reason(text: Column) -> Column:
    """Why a text has no line-anchored item: glued digits, midline, the word alone, none."""
    return F.when(text.rlike(r"(?im)^\s*item[1-9]\.\d{2}"), "glued").when(text.rlike(r"(?i)item\s+[1-9]\.\d{2}"), "midline").when(text.rlike(r"(?i)\bitem\b"), "item_word").otherwise("none")


def factor_block(text: str, expected: list[str]) -> list[tuple]:
    """Rows (date, *values as decimals or None) of the one contiguous ``yyyymmdd,`` block of a factor file."""
    rows, header, seen, inside = [], None, False, False
    for line in text.splitlines():
        if re.match(r"^\s*\d{8}\s*,", line):
            if seen and not inside:
                raise ValueError("a second block of daily rows")
            seen = inside = True
            cells = [c.strip() for c in line.split(",")]
            values = [None if float(c) in MISSING else float(c) / 100 for c in cells[1:]]
            if len(values) != len(expected):
                raise ValueError(f"{len(values)} values, {len(expected)} are expected")
            rows.append((f"{cells[0][:4]}-{cells[0][4:6]}-{cells[0][6:]}", *values))
        else:
            inside = False
            if not seen and "," in line:
                header = [c.strip().lower().replace("-", "_") for c in line.split(",")[1:]]
    if not rows:
        raise ValueError("no daily rows")
    if header != [e.lower() for e in expected]:
        raise ValueError(f"columns {header}, {expected} are expected")
    return rows


def factor_files(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """Inner join on date of factor blocks {text: columns}, rows with a missing value left out; files are small by nature."""
    out = None
    for text, cols in texts.items():
        names = [c.lower() for c in cols]
        df = spark.createDataFrame(factor_block(text, names), "date string, " + ", ".join(f"{c} double" for c in names)).withColumn("date", F.to_date("date"))
        out = df if out is None else out.join(df, "date")
    return out.dropna()


def tsv_facts(spark: SparkSession, num: str, sub: str, tags: list[str], forms: list[str]) -> DataFrame:
    """Numeric facts joined to their submissions: whitelisted tags, no segments, no foreign currency; dates and amendments typed."""
    n = spark.read.option("header", True).option("sep", "\t").csv(num)
    s = spark.read.option("header", True).option("sep", "\t").csv(sub).where(F.col("form").isin(forms))
    foreign = F.col("uom").rlike("^[A-Z]{3}$") & (F.col("uom") != "USD")
    n = n.where(F.col("tag").isin(tags) & F.col("value").isNotNull() & F.col("segments").isNull() & F.col("coreg").isNull() & ~foreign)
    date = lambda c: F.to_date(c, "yyyyMMdd")
    j = n.join(s.select("adsh", "cik", "form", "period", "filed", "accepted"), "adsh")
    return j.select("adsh", F.lpad("cik", 10, "0").alias("cik"), "form", F.col("form").endswith("/A").alias("is_amendment"), date("period").alias("period"), date("filed").alias("filed"), F.to_timestamp("accepted").alias("accepted"), "tag", date("ddate").alias("ddate"), F.col("qtrs").cast("short").alias("qtrs"), "uom", F.col("value").cast("double").alias("value"))


def master_index(spark: SparkSession, path: str, forms: list[str]) -> DataFrame:
    """Five-field pipe lines of an index file: (cik, company, form, filed, accession)."""
    p = F.split("value", r"\|")
    rows = spark.read.text(path).where(F.size(p) == 5).select(F.lpad(F.trim(p[0]), 10, "0").alias("cik"), F.trim(p[1]).alias("company"), F.trim(p[2]).alias("form"), F.expr("try_to_date(trim(split(value, '[|]')[3]))").alias("filed"), F.regexp_replace(F.regexp_extract(p[4], r"([0-9-]+)\.txt", 1), "-", "").alias("accession"))
    return rows.where(F.col("form").isin(forms) & F.col("filed").isNotNull())


def attach_filers(spine: DataFrame, index: DataFrame) -> DataFrame:
    """spine (accession, subject_cik) with the lowest other party's cik and name, and the number of other parties."""
    j = index.join(spine.select("accession", "subject_cik"), "accession").where(F.col("cik") != F.col("subject_cik"))
    f = j.groupBy("accession").agg(F.min(F.struct("cik", "company")).alias("m"), F.count_distinct("cik").alias("n_filers"))
    return spine.join(f.select("accession", F.col("m.cik").alias("filer_cik"), F.col("m.company").alias("filer_name"), "n_filers"), "accession", "left").withColumn("n_filers", F.coalesce("n_filers", F.lit(0)))


def owner_trades(trans: DataFrame, submissions: DataFrame, owners: DataFrame) -> DataFrame:
    """Transactions with their submission and each reporting owner's roles (a row per owner); exact repeats dropped."""
    role = lambda w: F.coalesce(F.lower("relationship").contains(w), F.lit(False))
    o = owners.select("accession", "owner_cik", role("officer").alias("is_officer"), role("director").alias("is_director"), role("tenpercent").alias("is_tenpct"))
    return trans.join(submissions, "accession", "left").join(o, "accession", "left").dropDuplicates()


def qualifying_buys(trades: DataFrame) -> DataFrame:
    """Open-market buys, not amended, by officers or directors."""
    return trades.where((F.col("trans_code") == "P") & ~F.col("is_amendment") & (F.col("is_officer") | F.col("is_director")))


def vintage_map(holdings: DataFrame) -> DataFrame:
    """(cusip8, ticker, first_seen, last_seen), cusips of more than one ticker left out."""
    g = holdings.groupBy(F.substring("cusip", 1, 8).alias("cusip8"), "ticker").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    return g.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cusip8"))).where("_n = 1").drop("_n")


def klines(raw: DataFrame) -> DataFrame:
    """Candles with open_time in epoch milli- or microseconds and text numbers -> typed rows with a UTC date."""
    num = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume"]
    return raw.select("symbol", S.epoch_date(F.col("open_time")).alias("date"), *(F.col(c).cast("double").alias(c) for c in num if c in raw.columns))


def daily_metrics(snaps: DataFrame, cols: list[str]) -> DataFrame:
    """Per symbol and day the last and the mean of each column of intraday snapshots (symbol, ts, cols)."""
    return snaps.groupBy("symbol", F.to_date("ts").alias("date")).agg(*(F.max_by(c, "ts").alias(f"{c}_last") for c in cols), *(F.avg(c).alias(f"{c}_mean") for c in cols))


def tick_lines(spark: SparkSession, path: str) -> DataFrame:
    """{t_local, src, msg} JSON lines (gz or plain); lines that do not parse and broken files are skipped."""
    raw = spark.read.option("ignoreCorruptFiles", True).text(path)
    row = F.from_json("value", TICK, {"mode": "PERMISSIVE"})
    return raw.select(row.alias("r")).select("r.*").where("t_local is not null").withColumn("ts", F.timestamp_micros("t_local"))


def to_eastern(utc: Column) -> Column:
    return F.from_utc_timestamp(utc, "America/New_York")


def repaired_eastern(df: DataFrame, raw: str, filed: str) -> DataFrame:
    """df with eastern time of ``raw`` (UTC), taken as eastern already where the converted time is out of filing hours (6-22h) and the raw one is not, or where the conversion moves the date before the filing date."""
    east = to_eastern(F.col(raw))
    out = (F.hour(east) < 6) | (F.hour(east) >= 22)
    fits = F.hour(raw).between(6, 21)
    mislabelled = (out & fits) | ((F.to_date(east) < F.col(filed)) & (F.to_date(raw) == F.col(filed)))
    return df.withColumn("eastern", F.when(mislabelled, F.col(raw)).otherwise(east)).withColumn("reinterpreted", F.coalesce(mislabelled, F.lit(False)))


def modal_prefix(rows: DataFrame, least: int = 3) -> DataFrame:
    """(ticker, prefix): each ticker's most frequent 10-character accession prefix, with at least so many rows (ties: the lower)."""
    g = rows.groupBy("ticker", F.substring("accession", 1, 10).alias("prefix")).count().where(F.col("count") >= least)
    return g.groupBy("ticker").agg(F.min_by("prefix", F.struct(-F.col("count"), "prefix")).alias("prefix"))


def cycle_dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Settlement cycle dates: the 15th and the last day of each month in the range."""
    m = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m"))
    d = m.select(F.explode(F.array(F.date_add("m", 14), F.last_day("m"))).alias("date"))
    return d.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def add_business_days(day: Column, n: int = 10) -> Column:
    """n Mon-Fri days on (n a multiple of 5); a weekend start counts from the Friday before."""
    back = F.when(F.dayofweek(day) == 7, 1).when(F.dayofweek(day) == 1, 2).otherwise(0)
    return F.date_add(F.date_sub(day, back), n // 5 * 7)


def parquet_inventory(spark: SparkSession, path: str, date_column: str | None = None) -> DataFrame:
    """One row: rows, columns and date span of a table; counts and extremes come from the footers."""
    df = spark.read.parquet(path)
    span = [F.min(date_column).alias("first"), F.max(date_column).alias("last")] if date_column in df.columns else []
    return df.agg(F.count(F.lit(1)).alias("rows"), *span).withColumn("columns", F.lit(len(df.columns)))
