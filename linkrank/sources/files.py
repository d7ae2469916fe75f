"""CSV, JSON and table reads and writes under an explicit contract."""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkrank.functions.text import VARIANT_MARKERS, has_any_marker
from linkrank.runtime import scratch_path, write_table

CORRUPT = "_corrupt_record"
SNAPSHOT = "snapshot_date"

TEXT, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Fixed formats: column names and order of the files.
CHART_ENTRIES = _table(
    chart_week=TEXT,
    current_week=INT,
    title=TEXT,
    performer=TEXT,
    last_week=TEXT,
    peak_pos=TEXT,
    wks_on_chart=INT,
)
TRACKS = _table(artist=TEXT, track=TEXT, playcount=LONG, listeners=LONG)
DETAILS = _table(artist=TEXT, track=TEXT, album=TEXT, tags=TEXT, duration_ms=LONG)
PLAYLIST = _table(artist=TEXT, track=TEXT)
RELEASE_YEARS = _table(
    artist=TEXT,
    track=TEXT,
    debut_decade=TEXT,
    release_year=INT,
    release_decade=TEXT,
    mb_score=INT,
    matched=INT,
)


class Contracted(NamedTuple):
    """Rows that kept the contract, and the raw text of those that did not."""

    good: DataFrame
    bad: DataFrame


def csv_options(reader):
    """The contract's options for a batch or a stream reader with a schema."""
    return (
        reader.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("enforceSchema", False)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
    )


def _csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, TEXT)]))
    return csv_options(reader).option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def _is_bad(schema: T.StructType) -> Column:
    """True for a row that broke the contract.

    Spark only converts the columns a query needs, so a bare count would miss text
    where a number belongs; the test touches every column to have all of them read.
    """
    texts = [F.col(f.name).cast("string") for f in schema.fields]
    return F.col(CORRUPT).isNotNull() & (F.length(F.concat_ws("", *texts)) >= 0)


def _kept(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows that kept the contract, blank text as ''."""
    texts = [f.name for f in schema.fields if f.dataType == TEXT]
    return raw.where(~_is_bad(schema)).drop(CORRUPT).na.fill("", subset=texts)


def read_csv_contract(spark: SparkSession, path, schema: T.StructType) -> Contracted:
    """Read a CSV whose header and column count must match ``schema``.

    Quoted texts may hold line breaks, so a file is read by one task: large tables should
    come as many files, as Spark writes them.

    A header with other names raises; a line with too many or too few fields, or
    with text where a number belongs, lands in ``bad``. Blank text stays ''.
    """
    raw = _csv(spark, path, schema)
    return Contracted(_kept(raw, schema), raw.where(_is_bad(schema)))


def snapshot_dates(df: DataFrame) -> list[str]:
    """Dates of the snapshot folders a table is read from, oldest first; no file is opened."""
    return sorted({d for f in df.inputFiles() for d in re.findall(rf"/{SNAPSHOT}=([0-9-]+)/", f)})


def read_snapshots(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    date: str | None = None,
    every: bool = False,
    dates: list[str] | None = None,
) -> Contracted:
    """The newest snapshot under ``root``, or that of a date or several, or every one; other
    folders are pruned."""
    raw = _csv(spark, root, T.StructType([*schema.fields, T.StructField(SNAPSHOT, T.DateType())]))
    if not every:
        dates = dates if dates is not None else [date] if date is not None else snapshot_dates(raw)[-1:]
        raw = raw.where(F.col(SNAPSHOT).isin([F.lit(d).cast("date") for d in dates]))
    return Contracted(_kept(raw, schema), raw.where(_is_bad(schema)))


def roster_scan(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """One column in order; ``limit`` is the sample-first mode."""
    ordered = df.select(col).orderBy(col)
    return ordered if limit is None else ordered.limit(limit)


def _csv_writer(df: DataFrame):
    return (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
    )


def write_dated_csv(df: DataFrame, root: str, date: str) -> str:
    """Write one snapshot; writing the same date again replaces it."""
    path = f"{root.rstrip('/')}/{SNAPSHOT}={date}"
    _csv_writer(df).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_playlist_csv(df: DataFrame, path: str) -> str:
    _csv_writer(df.select("artist", "track")).csv(path)
    return path


def freeze(df: DataFrame, path: str | None = None) -> DataFrame:
    """``CREATE TABLE AS``: write ``df`` and read it back. Overwrites, so it can be re-run."""
    return write_table(df, path or scratch_path(df.sparkSession, "frozen"))


def store_by_key(df: DataFrame, table: str, keys: list[str], buckets: int) -> DataFrame:
    """Store a table by its join keys, in place of an index.

    Two tables stored on the same keys and bucket count join without a shuffle. Use it
    for one-row-per-key tables: a hot key would fill one bucket. The table's name is that of the
    application with ``table``, so that two sessions on one catalog do not meet.
    """
    spark = df.sparkSession
    name = re.sub(r"\W", "_", f"{spark.sparkContext.applicationId}_{table}").lower()
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", scratch_path(spark, table)).saveAsTable(name)
    return spark.table(name)


VERSIONS = T.StructType(
    [T.StructField("version", LONG), T.StructField("folder", TEXT), T.StructField("before", LONG), T.StructField("after", LONG)]
)


class VersionedTable:
    """A table that is rebuilt beside the old one, which stays readable until the new one is whole.

    A version is a folder of its own under ``root``. Only when it is written, a row in
    ``root/versions`` names it, with the rows before and after. Readers take the newest version on
    record, so a step that dies midway changes nothing for them and can be done again.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def history(self) -> DataFrame:
        """version, folder, before, after; none before the first build."""
        return self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions") if self._exists() else self.spark.createDataFrame([], VERSIONS)

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _newest(self):
        return self.history().orderBy(F.desc("version")).limit(1).first()

    def current(self) -> DataFrame:
        newest = self._newest()
        if newest is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{newest['folder']}")

    def replace(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as the new version; its rows are counted as they are written."""
        newest = self._newest()
        version = 1 if newest is None else newest["version"] + 1
        folder = f"version={version}-{uuid.uuid4().hex}"
        seen = Observation(f"rows of {folder}")
        counted = df.select(*self.schema.names).observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.parquet(f"{self.root}/{folder}")
        row = (version, folder, 0 if newest is None else newest["after"], seen.get["n"])
        self.spark.createDataFrame([row], VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return self.current()

    def delete(self, condition: Column) -> DataFrame:
        """``DELETE WHERE``: the rewritten table; counts before and after go on record."""
        return self.replace(delete_where(self.current(), condition))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """``DELETE WHERE``: only rows where the condition is TRUE go; NULL keeps the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_counts(df: DataFrame, col: Column, markers=VARIANT_MARKERS) -> DataFrame:
    """Rows before and after deleting what holds a marker, and rows that hold each one."""
    counts = {"before": F.count("*"), "after": F.count_if(~F.coalesce(has_any_marker(col, markers), F.lit(False)))}
    counts |= {m: F.count_if(F.contains(F.lower(col), F.lit(m))) for m in markers}
    cells = [F.struct(F.lit(k).alias("counted"), v.alias("row_count")) for k, v in counts.items()]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def input_files(spark: SparkSession, path, kind: str = "parquet") -> DataFrame:
    """One row per input file of a table: file_name, bytes. No column of the data is read."""
    found = spark.read.format(kind).load(path)
    return found.select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size").distinct().select(
        "file_name", F.col("file_size").alias("bytes")
    )


def file_verdicts(files: DataFrame, smallest: int, largest: int) -> DataFrame:
    """Files far smaller or larger than a table's file should be: an error page, a cut download."""
    verdict = F.when(F.col("bytes") < smallest, "too small").when(F.col("bytes") > largest, "too large")
    return files.withColumn("verdict", F.coalesce(verdict, F.lit("plausible")))


def file_sizes(spark: SparkSession, path) -> DataFrame:
    """Name and length of each file of any kind, with or without rows; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"))
    )


def folder_sizes(spark: SparkSession, path, folder: str, smallest: int, largest: int) -> DataFrame:
    """Bytes under each partition folder of a written table, and whether that is plausible."""
    sizes = spark.read.format("binaryFile").load(path).groupBy(folder).agg(F.sum("length").alias("bytes"))
    return file_verdicts(sizes, smallest, largest)


def suspicious_files(spark: SparkSession, path, smallest: int, largest: int) -> DataFrame:
    return file_sizes(spark, path).where(~F.col("bytes").between(smallest, largest))
