"""Indicator files in, panel and matrix files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillpanel.functions.numeric import not_nan
from quillpanel.functions.text import parse_period
from quillpanel.operators.assembly import pivot_panel, union_long
from quillpanel.session import stage


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header CSV with a declared schema: no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_indicator(
    spark: SparkSession, path: str, indicator: str, entity: str, period: str, fmt: str = "csv"
) -> DataFrame:
    """One indicator file as (entity, period, indicator, value) with the period parsed and NaN made NULL."""
    schema = f"{entity} string, {period} string, {indicator} double"
    raw = read_csv(spark, path, schema) if fmt == "csv" else spark.read.format(fmt).load(path)
    return raw.select(
        F.col(entity).cast("string").alias(entity),
        parse_period(F.col(period)).alias(period),
        F.lit(indicator).alias("indicator"),
        not_nan(F.col(indicator).cast("double")).alias("value"),
    )


def _fields(line: Column, size: int) -> Column:
    """The ``size`` first fields of a CSV line, which may be quoted, as an array."""
    names = [f"c{i}" for i in range(size)]
    parsed = F.from_csv(line, ", ".join(f"{n} string" for n in names))
    return F.array(*[parsed[n] for n in names])


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` as files below it are named, with a single slash after ``file:``."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm).toString()


def landed_lines(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, dict[str, str]]:
    """source, file and line of all text files of all ``paths`` from one scan, and why a path could not be found."""
    found, problems = {}, {}
    for source, path in paths.items():
        try:
            spark.read.text(path)  # resolves the path now
            found[source] = _qualified(spark, path).rstrip("/")
        except Exception as error:  # one missing source must not stop the rest
            problems[source] = str(error).splitlines()[0][:200]
    if not found:
        return None, problems
    file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    source = F.lit(None).cast("string")
    for name, path in sorted(found.items(), key=lambda x: len(x[1])):  # the longest path that fits names the source
        source = F.when((file == path) | F.startswith(file, F.lit(path + "/")), name).otherwise(source)
    lines = spark.read.text([paths[s] for s in found])
    return lines.select(source.alias("source"), file.alias("file"), F.col("value").alias("line")).where("trim(line) <> ''"), problems


def landed_rows(lines: DataFrame, needed: Column) -> DataFrame:
    """source, the fields ``needed`` (an array of names per source) by name, ``bad``: the line can't be read so.

    Every file has a header line of its own, which holds the names in any order; a file's header is the
    line that has all of them.  Lines of a file without one are bad.  The headers, a row per file, come
    from a first pass, as a part of a split file does not know its file's first line.
    """
    spark = lines.sparkSession
    names = F.transform(F.split("line", ","), lambda x: F.trim(F.translate(x, '"\ufeff', "")))
    heads = lines.select("source", "file", names.alias("names")).where(F.size(F.array_except(needed, "names")) == 0)
    heads = stage(heads.groupBy("source", "file").agg(F.min("names").alias("header")), "headers")
    size = heads.agg(F.max(F.size("header"))).first()[0] or 1
    rows = lines.join(heads.select("file", "header"), "file", "left").select("source", "line", names.alias("names"), "header")
    rows = rows.where(F.col("header").isNull() | (F.col("names") != F.col("header")))  # headers are no rows
    fields = rows.select("source", "header", _fields(F.col("line"), size).alias("fields"))
    by_name = F.transform(needed, lambda n: F.get("fields", (F.array_position("header", n) - 1).cast("int")))
    return fields.select("source", F.when(F.col("header").isNotNull(), by_name).alias("values"), F.col("header").isNull().alias("bad"))


def _report(spark: SparkSession, asked: list[str], problems: dict[str, str], rows: DataFrame | None) -> DataFrame:
    """indicator, status, rows, bad_rows, error for each one asked for."""
    listed = spark.createDataFrame([(i, problems.get(i)) for i in asked], "indicator string, error string")
    if rows is None:
        counted = listed.select("indicator", F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("bad_rows"), F.lit(None).cast("boolean").alias("headed"))
    else:
        counted = rows.groupBy("indicator").agg(
            F.count_if(~F.col("bad") & F.col("in_range")).alias("rows"), F.count_if("bad").alias("bad_rows"), F.bool_or("headed").alias("headed")
        )
    bad = F.coalesce("bad_rows", F.lit(0))
    unread = F.coalesce(~F.col("headed"), F.lit(False))
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(unread, F.lit("no header line with the columns that are needed"))
        .when(F.col("rows").isNull(), F.lit("no line"))
        .when(bad > 0, F.concat(bad.cast("string"), F.lit(" rows could not be read")))
    )
    failed = F.col("error").isNotNull() | unread
    status = F.when(failed, "failed").when(F.coalesce("rows", F.lit(0)) == 0, "empty").otherwise("loaded")
    return listed.join(counted, "indicator", "left").select(
        "indicator", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), bad.alias("bad_rows"), reason.alias("error")
    )


def _checked(rows: DataFrame, indicator: Column, entity: str, period: str, first: int, last: int) -> DataFrame:
    """(entity, period, indicator, value, bad, in_range, headed) of landed rows whose values are entity, period, value."""
    text = F.trim(F.get("values", F.lit(2)))
    value = text.try_cast("double")
    missing = F.coalesce(text, F.lit("")) == ""
    plain = rows.select(
        F.get("values", F.lit(0)).alias(entity), parse_period(F.trim(F.get("values", F.lit(1)))).alias(period),
        indicator.alias("indicator"), not_nan(value).alias("value"), (value.isNull() & ~missing).alias("odd"), (~F.col("bad")).alias("headed"),
    )
    bad = ~F.col("headed") | F.col(period).isNull() | (F.coalesce(F.col(entity), F.lit("")) == "") | F.col("odd")
    return plain.withColumn("bad", bad).withColumn("in_range", F.coalesce(F.col(period).between(first, last), F.lit(False))).drop("odd")


def load_indicators(
    spark: SparkSession,
    paths: dict[str, str],
    first: int,
    last: int,
    entity: str = "country_code",
    period: str = "year",
    fmt: str = "csv",
) -> tuple[DataFrame, DataFrame]:
    """Panel of every indicator that can be read, and a status row for each one asked for.

    CSV sources are read in one scan of all their lines, each file by the names in its own header, so
    columns may stand in any order and others may be there.  A row whose period, entity or number can't be
    read is counted as bad and left out; a missing value is none.  A source without a path, without lines
    or without a header is reported with the reason, and the others load.  Values must not hold line
    breaks.  Other formats are resolved source by source.
    """
    if fmt == "csv":
        lines, problems = landed_lines(spark, paths)
        if lines is None:
            raise ValueError(f"no indicator could be read: {problems}")
        rows = _checked(landed_rows(lines, F.array(F.lit(entity), F.lit(period), F.col("source"))), F.col("source"), entity, period, first, last)
    else:
        frames, problems = {}, {}
        for indicator, path in paths.items():
            try:
                frames[indicator] = read_indicator(spark, path, indicator, entity, period, fmt)
            except Exception as error:  # one broken source must not stop the rest
                problems[indicator] = str(error).splitlines()[0][:200]
        if not frames:
            raise ValueError(f"no indicator could be read: {problems}")
        in_range = F.coalesce(F.col(period).between(first, last), F.lit(False))
        rows = union_long(list(frames.values())).select("*", F.col(period).isNull().alias("bad"), in_range.alias("in_range"), F.lit(True).alias("headed"))
    status = _report(spark, list(paths), problems, rows)
    good = rows.where(~F.col("bad") & F.col("in_range")).select(entity, period, "indicator", "value")
    return pivot_panel(good, [entity, period], [i for i in paths if i not in problems]), status


def load_long(
    spark: SparkSession,
    path: str,
    indicators: list[str],
    first: int,
    last: int,
    entity: str = "country_code",
    period: str = "year",
    indicator: str = "indicator",
    value: str = "value",
) -> tuple[DataFrame, DataFrame]:
    """As :func:`load_indicators`, from CSV files that hold all indicators, a row per entity, period and indicator.

    Rows of indicators that are not asked for are left out.
    """
    lines, problems = landed_lines(spark, {"all": path})
    if lines is None:
        raise ValueError(f"no indicator could be read: {problems['all']}")
    rows = landed_rows(lines, F.array(*[F.lit(c) for c in (entity, period, value, indicator)]))
    rows = _checked(rows, F.get("values", F.lit(3)), entity, period, first, last).where(F.col("indicator").isin(indicators))
    good = rows.where(~F.col("bad") & F.col("in_range")).select(entity, period, "indicator", "value")
    return pivot_panel(good, [entity, period], indicators), _report(spark, indicators, {}, rows)


def write_panel(df: DataFrame, path: str, fmt: str = "parquet", period: str | None = None) -> None:
    """Panel sink.  With ``period`` the files are laid out by period, so snapshots prune folders."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if period:
        writer = writer.partitionBy(period)
    writer.save(path)


def publish_periods(df: DataFrame, path: str, period: str, entity: str) -> None:
    """Replace the periods that ``df`` holds in a parquet panel laid out by period; other periods' files stay as they are.

    Rows are dealt by ranges of (period, entity), so that a period with many rows is written by many tasks
    and files are sorted by entity.  All files are written aside first; a period's folder is switched when
    the job commits, and a job that fails before leaves the panel as it was.
    """
    rows = df.repartitionByRange(period, entity).sortWithinPartitions(period, entity)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def write_matrix(long: DataFrame, path: str, labels: list[str], row: str = "x", column: str = "y", value: str = "corr") -> None:
    """Long matrix as a wide CSV with the row label in the first column."""
    wide = long.groupBy(row).pivot(column, labels).agg(F.first(value)).orderBy(row)
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # one row per metric column
