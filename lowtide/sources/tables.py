"""Readers: tables, directories, ticker lists, wide price tables, catch logs."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide import schemas
from lowtide.functions.values import clean_double, clean_number, clean_text, volume_or_zero


def parameterised_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """Run SQL with named parameters (``:name``) over the registered views."""
    return spark.sql(sql, args=params or {})


def ticker_lists(spark: SparkSession, path: str, one_document_per_file: bool = True) -> DataFrame:
    """Curated ticker lists, JSON documents with an array -> (exchange, ticker, position)."""
    schema = "exchange string, index_name string, source_date string, tickers array<string>"
    docs = spark.read.schema(schema).option("multiLine", one_document_per_file).json(path)
    return docs.select("exchange", "index_name", F.posexplode("tickers").alias("position", "ticker"))


def directory_search(directory: DataFrame, exchange: str) -> DataFrame:
    """Listings of one exchange."""
    return directory.filter(F.col("exchange") == exchange)


PRICE_FIELDS = ("Open", "High", "Low", "Close", "Volume")


def wide_to_bars(wide: DataFrame, separator: str = "|", date: str = "Date") -> DataFrame:
    """Wide prices (one column per ``ticker|Field``) -> one row per ticker and day.

    The columns of one ticker are packed into a struct and all structs are inlined: a
    narrow transformation without any shuffle.
    """
    tickers = sorted({c.rsplit(separator, 1)[0] for c in wide.columns if separator in c})

    def field(ticker: str, name: str):
        column = f"{ticker}{separator}{name}"
        return F.col(f"`{column}`") if column in wide.columns else F.lit(None)

    packed = [
        F.struct(
            F.lit(t).alias("ticker"),
            *[
                clean_number(field(t, f).cast("string")).alias(f.lower())
                for f in PRICE_FIELDS
                if f != "Volume"
            ],
            volume_or_zero(field(t, "Volume")).alias("volume"),
        )
        for t in tickers
    ]
    return wide.select(
        F.col(date).cast("date").alias("price_date"), F.inline(F.array(*packed))
    ).select("ticker", "price_date", "open", "high", "low", "close", "volume")


def ingest_wide(wide: DataFrame, source: str, **options) -> DataFrame:
    """Wide prices -> complete bars labelled with their source; incomplete rows are dropped."""
    return (
        wide_to_bars(wide, **options)
        .dropna(how="any", subset=["open", "high", "low", "close"])
        .withColumn("source", F.lit(source))
    )


#: one value of a log line, which is read with a comma before it; quotes inside are doubled or escaped
_VALUE = r',("(?:[^"\\]|\\.|"")*"|[^,]*)'


def _catch_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """Lines of a catch log by column name: ``fields`` (name -> text) and, typed, ``row``.

    Every file is read by its own header line, whatever its column order; a value holds no line
    break.  ``issue`` says what is
    wrong with a line: a number of values other than the header's, or a value that does not fit its
    column.  None if the log cannot be read.

    Values and fields come out of one-element arrays, so that filters on them stay above them and no
    line is cut again for each term."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return None
    quoted = lambda v: F.when(
        v.startswith('"'), F.regexp_replace(F.substr(v, F.lit(2), F.length(v) - 2), r'[\\"](["\\])', "$1")
    ).otherwise(v)
    found = F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(_VALUE), F.lit(1))
    cut = lambda rows: rows.select(
        F.explode(F.array(F.transform(found, quoted))).alias("values"), "file"
    )
    lines = lines.filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    is_header = F.array_contains("values", "ticker") & F.array_contains("values", "price")
    # only lines that hold both names are cut to look for headers
    likely = lines.filter(F.contains("value", F.lit("ticker")) & F.contains("value", F.lit("price")))
    headers = cut(likely).filter(is_header).groupBy("file").agg(F.min("values").alias("header"))
    named = cut(lines).filter(~is_header).join(F.broadcast(headers), "file", "left")
    fits = F.size("values") == F.size("header")
    fields = F.when(fits, F.map_from_arrays("header", "values"))
    fields = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    named = named.select("*", F.explode(F.array(fields)).alias("fields"))
    kinds = [part.split() for part in schemas.CATCHES.split(",")]
    text = lambda n: F.nullif(F.try_element_at("fields", F.lit(n)), F.lit(""))
    row = F.struct(
        *[
            (F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")) if kind == "string" else text(n).try_cast(kind)).alias(n)
            for n, kind in kinds
        ]
    )
    wrong = [
        F.when(text(n).isNotNull() & text(n).try_cast(kind).isNull(), F.lit(n)) for n, kind in kinds if kind != "string"
    ]
    issue = F.when(~F.coalesce(fits, F.lit(False)), F.lit("number of values")).otherwise(
        F.nullif(F.concat_ws(",", *wrong), F.lit(""))
    )
    return named.select("file", "values", "fields", row.alias("row"), issue.alias("issue"))


def read_catches(spark: SparkSession, path: str) -> DataFrame:
    """Read back the catch log: its fixed columns, found by name in the header of each file.

    Lines that do not fit are left to ``malformed_catches``; a log that cannot be read is empty."""
    lines = _catch_lines(spark, path)
    if lines is None:
        return schemas.empty(spark, "catches")
    return lines.filter(F.col("issue").isNull()).select("row.*")


def malformed_catches(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a catch log that do not fit: file, values, values by column name, and the issue."""
    lines = _catch_lines(spark, path)
    if lines is None:
        return spark.createDataFrame([], "file string, values array<string>, fields map<string,string>, issue string")
    return lines.filter(F.col("issue").isNotNull()).select("file", "values", "fields", "issue")


def clean_missing(df: DataFrame) -> DataFrame:
    """Landing clean-up: NaN becomes NULL in every double column, blanks in every string."""
    fixed = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            fixed[name] = clean_double(F.col(name))
        elif kind == "string":
            fixed[name] = clean_text(F.col(name))
        elif kind in ("array<double>", "array<float>"):
            fixed[name] = F.transform(F.col(name), lambda x: F.when(~F.isnan(x), x))
    return df.withColumns(fixed) if fixed else df


def land_raw(df: DataFrame, path: str) -> None:
    clean_missing(df).write.mode("append").parquet(path)


def key_set(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Sorted distinct keys; repeats would otherwise all sort into one partition."""
    return df.select(key).distinct().orderBy(key)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
