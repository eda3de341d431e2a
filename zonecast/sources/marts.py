"""Reading and writing marts as Parquet or headered CSV. Marts are published whole: readers see the old version or the new one."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.operators.cleaning import drop_blank_rows, normalise_columns, normalise_key
from zonecast.operators.ordering import with_position
from zonecast.session import materialize
from zonecast.sources.publish import current, draft, partition_values, publish
from zonecast.sources.schemas import MARTS


class MissingInput(FileNotFoundError):
    """An input or a mart that an earlier job should have written is absent."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Headered CSV; with no schema the types are inferred, blank rows dropped and column names normalised."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    path = current(spark, path)
    try:
        if schema is not None:
            # the header is checked against the schema instead of being ignored
            return reader.option("enforceSchema", False).schema(schema).csv(path)
        return normalise_columns(drop_blank_rows(reader.option("inferSchema", True).csv(path)))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingInput(f"no CSV table at {path}") from e


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, hint: str = "") -> DataFrame:
    """Parquet table, pruned to `columns`; MissingInput with a hint if it is not there."""
    try:
        df = spark.read.parquet(current(spark, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingInput(f"no table at {path}. {hint}".strip()) from e
    return df if columns is None else df.select(*columns)


def read_or_default(
    spark: SparkSession, path: str, schema: T.StructType, default: list | None = None, fmt: str = "parquet"
) -> DataFrame:
    """The mart, or `default` rows (none if not given) where it does not exist."""
    try:
        return read_table(spark, path) if fmt == "parquet" else read_csv(spark, path, schema)
    except MissingInput:
        return spark.createDataFrame(default or [], schema)


def write_mart(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Write a new version of a mart and make it current; a write that fails leaves the version before."""
    folder = draft(path)
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True)
    getattr(writer, fmt)(folder)
    publish(df.sparkSession, path, folder)


def write_ordered(df: DataFrame, path: str, order: list[Column], fmt: str = "parquet") -> None:
    """A mart in `order`, a total order: files follow each other in it and `position` holds the place of each row from 0."""
    placed = with_position(df, order, "position")
    # positions were given in range partitions; the rows of a file stay together and sorted
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_mart(placed.repartitionByRange(parts, "position").sortWithinPartitions("position"), path, fmt)


def write_panel(features: DataFrame, path: str) -> None:
    """Panel features, one folder per month, files in (zone, date) order."""
    month = F.date_format("created_date", "yyyy-MM")
    # a month goes to few tasks, and a large one is split again by size
    dated = features.withColumn("panel_month", month).hint("rebalance", "panel_month").sortWithinPartitions("panel_month", "zone_id", "created_date")
    write_mart(dated, path, by=["panel_month"])


def append_panel(features: DataFrame, path: str) -> None:
    """Put the rows of `features` in place of those of the panel at `path` from their first date on; other months are not touched."""
    spark = features.sparkSession
    dated = materialize(features.withColumn("panel_month", F.date_format("created_date", "yyyy-MM")), "appended")
    first = dated.agg(F.min("created_date")).first()[0]
    if first is None:
        return
    months = [r.panel_month for r in dated.select("panel_month").distinct().collect()]  # a row per month
    # partition values of digits and dashes may come back as dates; the stored text is what counts
    stored = read_table(spark, path).withColumn("panel_month", F.col("panel_month").cast("string"))
    kept = stored.filter(F.col("panel_month").isin(months) & (F.col("created_date") < F.lit(first)))
    whole = materialize(kept.unionByName(dated), "months")  # the months are overwritten while nothing reads them
    whole = whole.hint("rebalance", "panel_month").sortWithinPartitions("panel_month", "zone_id", "created_date")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("panel_month").parquet(current(spark, path))


def read_last_month(spark: SparkSession, path: str, hint: str = "") -> DataFrame:
    """The last month of a panel that `write_panel` wrote, named from its folders, so that only its files are read."""
    months = partition_values(spark, current(spark, path), "panel_month")
    panel = read_table(spark, path, hint=hint)
    return panel.filter(F.col("panel_month") == F.lit(months[-1])) if months else panel


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows that fit `schema`, and `record, reason` of those that do not: `columns` (their number), `date` or `field` (a value).

    Written once, so that both sides come from the same reading.
    """
    corrupt = "_corrupt"
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    try:
        read = reader.schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])).csv(current(spark, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise MissingInput(f"no CSV table at {path}") from e
    rows = materialize(read, "csv")
    texts = F.from_csv(F.col(corrupt), ", ".join(f"`{f.name}` string" for f in schema.fields))
    wrong = lambda f: texts[f.name].isNotNull() & texts[f.name].try_cast(f.dataType).isNull()
    number = F.size(F.split(F.regexp_replace(corrupt, '"[^"]*"', ""), ",", -1))
    dates = [wrong(f) for f in schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType))]
    reason = F.when(number != len(schema.fields), "columns").when(reduce(lambda a, b: a | b, dates, F.lit(False)), "date").otherwise("field")
    rejected = rows.filter(F.col(corrupt).isNotNull()).select(F.col(corrupt).alias("record"), reason.alias("reason"))
    return rows.filter(F.col(corrupt).isNull()).drop(corrupt), rejected


def load_catalog(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Every known mart under `root` as a temporary view; absent marts are empty. Zone keys are normalised."""
    out = {}
    for name, schema in MARTS.items():
        df = normalise_columns(read_or_default(spark, f"{root}/{name}", schema, fmt=fmt))
        if "zone_id" in df.columns:
            df = df.withColumn("zone_id", normalise_key(F.col("zone_id")))
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def parse_parameters(text: Column) -> Column:
    """JSON parameter text to a map of texts."""
    return F.from_json(text, T.MapType(T.StringType(), T.StringType()))
