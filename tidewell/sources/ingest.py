"""Messy CSV ingest and schema normalisation (S1-S9, S12, S13, S16; string clean-up F16:
trim, lower, replace, regex strip of headers and values).

Files are read as text so that the repairs of raw text (BOM, rows wrapped whole in
quotes, a single quoted header, records over several lines) happen before CSV
parsing; parsing is ``from_csv`` per record, all JVM-side.  Many files of several
layouts are one scan.  Only the distinct layouts (header lines) and one-row
aggregates (failure ratios, role profiles) reach the driver.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.features import few_distinct
from tidewell.operators.reconcile import dedupe_last
from tidewell.session import cut_lineage
from tidewell.sources import runs

BOM = "﻿"
REQUIRED = ("Date", "Product", "Demand")

# Column aliases of the main loader (key = lower case, spaces -> "_").
ALIASES = {
    "weekly_sales": "Demand", "sales": "Demand", "units": "Demand",
    "quantity": "Demand", "target": "Demand", "revenue": "Demand",
    "date": "Date", "week": "Date", "order_date": "Date",
    "store": "Store", "store_id": "Store", "shop": "Store",
    "product": "Product", "item": "Product", "product_id": "Product",
    "item_id": "Product", "sku": "Product", "category": "Product",
    "holiday_flag": "Holiday_Flag", "is_holiday": "Holiday_Flag",
    "holiday": "Holiday_Flag", "isholiday": "Holiday_Flag",
    "temperature": "Temperature", "temp": "Temperature",
    "fuel_price": "Fuel_Price", "fuel": "Fuel_Price",
    "cpi": "CPI", "unemployment": "Unemployment",
}

# Aliases of the actuals upload (key also maps "-" -> "_").
ACTUALS_ALIASES = {
    **{k: "Demand" for k in ("sales", "weekly_sales", "units", "quantity", "demand", "actual", "actual_demand")},
    **{k: "Date" for k in ("date", "week", "order_date", "time", "timestamp", "period")},
    **{k: "Product" for k in ("item", "product_id", "item_id", "sku", "category", "product")},
    **{k: "Store" for k in ("store", "store_id", "location", "shop")},
}

# Report-side aliases.
REPORT_ALIASES = {"weekly_sales": "actual", "demand": "actual", "predicted": "prediction"}

# Day-first formats tried in order, then month-first / ISO as the fallback parse.
DAY_FIRST = ["d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "d-M-yy", "d/M/yy",
             "yyyy-M-d H:m:s", "d-M-yyyy H:m", "d/M/yyyy H:m"]
MONTH_FIRST = ["yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "M/d/yy", "yyyy-M-d H:m:s"]


# ── S1, S2, S2b ────────────────────────────────────────────────────────────
# A whole row as one quoted field (quotes inside doubled), and any row with outer quotes.
ONE_FIELD = '(?s)^"((?:[^"]|"")*)"$'
OUTER_QUOTES = '(?s)^"(.*)"$'
META = ("_file", "_block", "_line")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with their file, the start of their block and their order in it. Lines of a
    block are read by one task, so (file, block, line) is the order of the file."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    return lines.withColumns({"_line": F.monotonically_increasing_id(),
                              "value": F.regexp_replace("value", f"^{BOM}|\r$", "")})


def _quotes(column: str = "value") -> F.Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit('"'), F.lit("")))


def block_stats(lines: DataFrame) -> DataFrame:
    """Per block of a file: lines, quotes, lines with an odd number of quotes, first line."""
    return lines.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_lines"), F.sum(_quotes()).alias("_quotes"),
        F.sum(_quotes() % 2).alias("_odd"), F.min_by("value", "_line").alias("_first"))


def join_records(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """Lines to records: a quoted field may hold line breaks.

    A line with an odd number of quotes opens such a field or closes it; the n-th odd line of
    a file opens where n is odd. The count of odd lines before a block is a prefix sum over the
    block table (a row per block); inside a block it is a window over that block's lines. Only
    blocks with an odd line, or inside an open field, take part; lines of other blocks are
    records as they are."""
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stats.select("_file", "_block", "_odd", F.coalesce(F.sum("_odd").over(before), F.lit(0)).alias("_before"))
    broken = blocks.where((F.col("_odd") > 0) | (F.col("_before") % 2 == 1)).drop("_odd")
    in_block = Window.partitionBy("_file", "_block").orderBy("_line")
    upto = F.col("_before") + F.sum(_quotes() % 2).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    near = lines.join(broken, ["_file", "_block"]).withColumn("_upto", upto)
    part = (F.col("_upto") % 2 == 1) | (_quotes() % 2 == 1)
    near = near.withColumn("_record", F.when(part, F.floor((F.col("_upto") + 1) / 2)))
    pieces = F.array_sort(F.collect_list(F.struct("_block", "_line", "value")))
    joined = (near.where("_record IS NOT NULL").groupBy("_file", "_record").agg(pieces.alias("_p"))
              .select("_file", F.col("_p")[0]["_block"].alias("_block"), F.col("_p")[0]["_line"].alias("_line"),
                      F.array_join(F.transform("_p", lambda p: p["value"]), "\n").alias("value")))
    whole = near.where("_record IS NULL").select("_file", "_block", "_line", "value")
    untouched = lines.join(broken, ["_file", "_block"], "left_anti").select("_file", "_block", "_line", "value")
    return untouched.unionByName(whole).unionByName(joined)


def _split_header(line: str) -> list[str]:
    return next(csv.reader([line]))


def _repair(header: str, mostly_quoted: bool) -> tuple[str, list[str]]:
    """(repair of a file's rows, header names): rows wrapped whole in quotes are unwrapped
    (S2); a single quoted header cell that holds commas means dropping every quote (S2b)."""
    names = _split_header(header)
    if len(names) == 1 and "," in names[0]:
        repair = "unwrap" if mostly_quoted else "drop"
        names = _split_header(names[0].replace('"', "") if repair == "drop" else names[0])
    else:
        repair = "unwrap_fields" if mostly_quoted and len(names) > 1 else "none"
    return repair, [n.strip().replace(BOM, "") for n in names]


def read_messy(spark: SparkSession, paths: str | list[str], rename=lambda names: names, required=()) -> DataFrame:
    """Files of any number of layouts in one scan: columns (strings) named by ``rename`` from
    each file's header, absent ones null, and the row's place (``META``). Every layout must
    hold the ``required`` names.

    One aggregate over the blocks finds every file's header and quoting. The driver sees the
    distinct (header, quoting) layouts only; a file's layout is joined to its rows, which are
    parsed once by the widest layout and read by position."""
    lines = read_lines(spark, paths)
    stats = cut_lineage(block_stats(lines))
    files = stats.groupBy("_file").agg(
        F.min_by("_first", "_block").alias("_header"),
        (F.sum("_quotes") > F.sum("_lines")).alias("_quoted"), F.sum("_odd").alias("_odd"))
    layouts = [tuple(r) for r in files.select("_header", "_quoted").distinct().orderBy("_header", "_quoted").collect()]
    if not layouts:
        raise ValueError(f"nothing to read in {paths}")
    repairs = [_repair(h, q) for h, q in layouts]
    names = [rename(n) for _, n in repairs]
    for own in names:
        require_columns(own, required)
    rows = lines
    if stats.where(F.col("_odd") > 0).limit(1).count():
        rows = join_records(lines, stats)
    layout = F.coalesce(*[F.when((F.col("_header") == h) & (F.col("_quoted") == q), i) for i, (h, q) in enumerate(layouts)])
    rows = (rows.join(files.select("_file", "_header", layout.alias("_layout")), "_file")
            .where((F.col("value") != F.col("_header")) & (F.length(F.trim("value")) > 0)))

    def of_kind(kind):
        return F.col("_layout").isin([i for i, (r, _) in enumerate(repairs) if r == kind])
    v = F.col("value")
    unwrapped = F.replace(F.regexp_replace(v, OUTER_QUOTES, "$1"), F.lit('""'), F.lit('"'))
    clean = (F.when(of_kind("unwrap") & v.rlike(OUTER_QUOTES), unwrapped)
             .when(of_kind("unwrap_fields") & v.rlike(ONE_FIELD) & v.contains(","), unwrapped)
             .when(of_kind("drop"), F.replace(v, F.lit('"'), F.lit(""))).otherwise(v))
    width = max(len(n) for n in names)
    schema = ", ".join(f"_c{i} STRING" for i in range(width))
    parsed = rows.select(*META, "_layout", F.from_csv(clean, schema, {"escape": '"'}).alias("_r"))
    out: dict[str, list] = {}
    for i, own in enumerate(names):
        for k, name in enumerate(own):
            out.setdefault(name, []).append((i, k))

    def value_of(places):
        if len(layouts) == 1:
            return F.col(f"_r._c{places[0][1]}")
        return F.coalesce(*[F.when(F.col("_layout") == i, F.col(f"_r._c{k}")) for i, k in places])
    return parsed.select(*META, *[value_of(p).alias(n) for n, p in out.items()])


def read_csv_messy(spark: SparkSession, path: str) -> DataFrame:
    """CSV with BOM, padded header names, line breaks in quotes and optionally rows wrapped in
    quotes; all columns strings, named as in the header."""
    return read_messy(spark, path).drop(*META)


# ── S3, S3b, S3c, S4 ───────────────────────────────────────────────────────
def canonical_names(names: list[str], aliases: dict[str, str] = ALIASES, dash: bool = False) -> list[str]:
    """Header names with aliases replaced, unless the canonical name is there already."""
    out, taken = [], set(names)
    for name in names:
        key = name.strip().lower().replace(" ", "_")
        target = aliases.get(key.replace("-", "_") if dash else key)
        if target and target not in taken:
            taken.add(target)
            out.append(target)
        else:
            out.append(name)
    return out


def normalise_columns(df: DataFrame, aliases: dict[str, str] = ALIASES, dash: bool = False) -> DataFrame:
    """Rename alias columns to canonical names unless the canonical one exists."""
    return df.toDF(*canonical_names(df.columns, aliases, dash))


def report_columns(df: DataFrame) -> DataFrame:
    """A stored prediction table under report names (S3c): actual, prediction."""
    return normalise_columns(df, REPORT_ALIASES)


def require_columns(names: list[str], required=REQUIRED) -> None:
    absent = [c for c in required if c not in names]
    if absent:
        raise ValueError(f"no column for {', '.join(absent)} among {', '.join(names)}; a demand file names "
                         f"{', '.join(required)} or one of their aliases")


# ── S5, S5b, S6, S7 ────────────────────────────────────────────────────────
def _parse(col: str, formats: list[str]) -> F.Column:
    c = F.trim(F.col(col).cast("string"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def parse_dates(df: DataFrame, col: str = "Date", file_col: str | None = None) -> DataFrame:
    """Day-first parse; where more than half of a file's rows (or of all rows, without
    ``file_col``) fail, the default parse; unparseable rows dropped (S5)."""
    first, other = _parse(col, DAY_FIRST), _parse(col, MONTH_FIRST)
    bad = (F.count_if(first.isNull()) > 0.5 * F.count(F.lit(1))).alias("_other")
    if file_col is None:
        parsed = other if df.agg(bad).first()["_other"] else first
        return df.withColumn(col, parsed).where(F.col(col).isNotNull())
    files = df.groupBy(file_col).agg(bad)
    return (df.join(files, file_col).withColumn(col, F.when(F.col("_other"), other).otherwise(first))
            .drop("_other").where(F.col(col).isNotNull()))


def _number(col: str) -> F.Column:
    return F.expr(f"try_cast(trim(`{col}`) AS DOUBLE)")


def parse_strict(df: DataFrame) -> DataFrame:
    """Dates day-first, then ISO, then US, and numeric Demand; every value must parse and every
    row name a product (S5b, S6 strict). One pass finds all faults of an upload."""
    c = F.trim(F.col("Date").cast("string"))
    date = F.coalesce(_parse("Date", DAY_FIRST), F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))),
                      F.to_date(F.try_to_timestamp(c, F.lit("MM/dd/yyyy"))))
    out = df.withColumns({"Date": date, "Demand": _number("Demand")})
    r = out.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in REQUIRED]).first()
    faults = [f"{r[k]} rows without a usable {k}" for k in REQUIRED if r[k]]
    if faults:
        raise ValueError("upload rejected: " + ", ".join(faults))
    return out


def coerce_numeric(df: DataFrame, col: str = "Demand") -> DataFrame:
    """``try_cast`` to double; rows that are no number are dropped."""
    return df.withColumn(col, _number(col)).where(F.col(col).isNotNull())


def cast_keys(df: DataFrame) -> DataFrame:
    """Store and Product as strings."""
    return df.withColumns({k: F.col(k).cast("string") for k in ("Store", "Product") if k in df.columns})


def infer_numeric(df: DataFrame, skip=("Date", "Store", "Product", *META)) -> DataFrame:
    """Cast string columns whose every non-empty value is a number to double (one aggregate)."""
    cand = [c for c, t in df.dtypes if t == "string" and c not in skip]
    if not cand:
        return df
    r = df.agg(*[F.count_if((F.trim(c) != "") & _number(c).isNull()).alias(c) for c in cand]).first()
    return df.withColumns({c: _number(c) for c in cand if r[c] == 0})


# ── S8 ─────────────────────────────────────────────────────────────────────
def profile_roles(df: DataFrame) -> dict:
    """Loader roles: numeric columns with <= 10 distinct values and < 1 % of rows are
    categorical; strings with < 50 distinct values are categorical (``few_distinct``)."""
    skip = {"Date", "Demand", "Store", "Product"}
    types = {c: t for c, t in df.dtypes if c not in skip}
    numbers = [c for c, t in types.items() if t in ("int", "bigint", "double", "float", "smallint")]
    strings = [c for c, t in types.items() if t == "string"]
    rows, few = few_distinct(df, {**dict.fromkeys(numbers, 11), **dict.fromkeys(strings, 50)})
    # few of the rows: with at least 1,100 rows ten values are always under 1 %
    scarce = few & set(numbers)
    if rows < 1100 and scarce:
        scarce = {c for c in scarce if df.select(c).where(F.col(c).isNotNull()).distinct().limit(11).count() < 0.01 * rows}
    categorical = [c for c in types if c in scarce or (c in strings and c in few)]
    return {"target": "Demand", "date": "Date", "has_store": "Store" in df.columns,
            "has_product": "Product" in df.columns, "has_holiday": "Holiday_Flag" in df.columns,
            "numeric_features": [c for c in numbers if c not in scarce], "categorical_features": categorical}


# ── the loaders ────────────────────────────────────────────────────────────
def load_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Demand files of any layouts, each repaired and parsed by its own header, quoting and date
    order, in one scan (S1-S7); with the row's place (``META``)."""
    df = parse_dates(read_messy(spark, paths, canonical_names, REQUIRED), file_col="_file")
    return infer_numeric(cast_keys(coerce_numeric(df, "Demand")))


def load_demand(spark: SparkSession, path: str) -> DataFrame:
    """The main loader: S1-S7 in the reference's order."""
    return load_files(spark, path).drop(*META)


def load_actuals(spark: SparkSession, path: str) -> DataFrame:
    """The actuals upload: wider aliases, strict parsing (S3b, S5b, S6 strict)."""
    df = read_messy(spark, path, lambda names: canonical_names(names, ACTUALS_ALIASES, dash=True),
                    REQUIRED).drop(*META)
    return infer_numeric(cast_keys(parse_strict(df)))


def _uri(spark: SparkSession, path: str) -> str:
    """A path as Spark's file metadata names it, without the slashes after the scheme."""
    fs, p = runs._path(spark, path)
    return _plain(fs.makeQualified(p).toUri().toString())


def _plain(uri: str) -> str:
    return re.sub("^[A-Za-z0-9+.-]+:/+", "/", uri)


def load_history(spark: SparkSession, base_path: str, upload_paths: list[str]) -> DataFrame:
    """Base file plus the uploads in name order; the last source wins per key.

    One scan for all files, however many: the base file ranks first, an upload ranks by its
    file name, and inside a file the row order decides."""
    df = load_files(spark, [base_path, *upload_paths])
    base = _uri(spark, base_path).rstrip("/")
    path = F.regexp_replace("_file", "^[A-Za-z0-9+.-]+:/+", "/")
    later = ~((path == base) | path.startswith(base + "/"))
    df = df.withColumns({"_later": later, "_name": F.element_at(F.split("_file", "/"), -1)})
    keys = [k for k in ("Store", "Product") if k in df.columns] + ["Date"]
    return dedupe_last(df, keys, order=("_later", "_name", *META)).drop("_later", "_name", *META)


# ── S10-S13, S16 on Parquet tables ─────────────────────────────────────────
def latest_per_month(spark: SparkSession, path: str, month_col: str = "month",
                     run_col: str = "run_ts") -> DataFrame:
    """Rows of the latest run per month (S10, W7): every file of the run with the greatest
    ``run_ts``. A table without that column holds one version of each month (months are
    replaced as a whole) and is returned as it is."""
    df = spark.read.parquet(path)
    if run_col not in df.columns:
        return df
    latest = df.groupBy(F.col(month_col).alias("_m")).agg(F.max(run_col).alias("_run"))
    return df.join(latest, F.col(month_col).eqNullSafe(F.col("_m")) & F.col(run_col).eqNullSafe(F.col("_run")), "left_semi")


def months_available(spark: SparkSession, path: str, month_col: str = "month") -> DataFrame:
    """Distinct months and the last write time of each."""
    df = spark.read.parquet(path).select(month_col, F.col("_metadata.file_modification_time").alias("mtime"))
    return df.groupBy(month_col).agg(F.max("mtime").alias("mtime")).orderBy(month_col)


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON record log (array of objects per file)."""
    return spark.read.json(path, multiLine=True)


def read_month(spark: SparkSession, path: str, month: str, month_col: str = "month") -> DataFrame:
    """One month of a month-partitioned table; the filter prunes partitions."""
    return spark.read.parquet(path).where(F.col(month_col) == month)
