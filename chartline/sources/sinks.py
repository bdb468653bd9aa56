"""Writing readings and events to files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chartline.layout import PATIENTS, Layout
from chartline.operators.combine import order_of
from chartline.operators.nearest import flag_event_rows
from chartline.sources.tables import DAY_FOLDER

# Keeps microseconds, which the CSV writer would otherwise cut to milliseconds.
_CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def _save(writer, path: str, fmt: str) -> None:
    if fmt == "csv":
        writer = writer.options(**_CSV_OPTIONS)
    writer.format(fmt).save(path)


def _time_column(df: DataFrame, layout: Layout) -> Column:
    """When a row happened: a reading's time, an event's own time or else its start."""
    return F.col(layout.time) if layout.time in df.columns else layout.event_time_of(df)


def write_per_patient(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", layout: Layout = PATIENTS
) -> None:
    """One folder per entity; entities without rows get none. For exports of few entities: millions of
    them would be millions of folders, for which ``write_packed`` is the layout.

    Rows are spread by entity and day, so a very large entity is written by many tasks.
    """
    when = _time_column(df, layout)
    spread = df.repartition(layout.entity, F.to_date(when)).sortWithinPartitions(
        layout.entity, when
    )
    _save(spread.write.mode(mode).partitionBy(layout.entity), path, fmt)


def write_combined(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", layout: Layout = PATIENTS
) -> None:
    """All rows ordered by entity and time across the files of one folder.

    Ranges are cut on both columns, so one large entity is split over files.
    """
    _save(df.orderBy(layout.entity, _time_column(df, layout)).write.mode(mode), path, fmt)


# Rows of a file of the packed layout, at most.
FILE_ROWS = 1_000_000
MANIFEST = "_manifest"


def write_packed(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", layout: Layout = PATIENTS,
    file_rows: int = FILE_ROWS, ties: tuple[str, ...] = (),
) -> None:
    """Files of at most ``file_rows`` rows, about as many as that takes, ordered by entity, time and ``ties``.

    Small entities share a file and large ones are cut over several, so neither millions of entities nor a single
    hot one makes files too small or too large. A manifest beside the files tells which entity is in which file, with
    the rows and times of it there.
    """
    order = order_of(df, ties, layout)
    files = -(-df.count() // file_rows) or 1
    packed = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    _save(packed.write.mode(mode).option("maxRecordsPerFile", file_rows), path, fmt)
    spark = df.sparkSession
    names = StructType([StructField(f.name, StringType() if fmt == "csv" else f.dataType) for f in df.schema.fields])
    written = spark.read.schema(names).options(**(_CSV_OPTIONS if fmt == "csv" else {})).format(fmt).load(path)
    when = _time_column(written, layout)
    _save(
        written.groupBy(layout.entity, F.col("_metadata.file_name").alias("file")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(when).alias("first_time"), F.max(when).alias("last_time")
        ).write.mode(mode), f"{path}/{MANIFEST}", "parquet",
    )


def read_packed(spark: SparkSession, path: str, entities: list, fmt: str = "parquet", layout: Layout = PATIENTS) -> DataFrame:
    """The rows of some entities: only files that the manifest names for them are opened."""
    held = spark.read.parquet(f"{path}/{MANIFEST}").where(F.col(layout.entity).isin(entities))
    files = sorted(r.file for r in held.select("file").distinct().collect())
    whole = spark.read.options(**(_CSV_OPTIONS if fmt == "csv" else {})).format(fmt).load(path)
    if not files:
        return whole.limit(0)
    some = spark.read.schema(whole.schema).options(**(_CSV_OPTIONS if fmt == "csv" else {})).format(fmt).load([f"{path}/{f}" for f in files])
    return some.where(F.col(layout.entity).isin(entities))


def read_numbered(spark: SparkSession, path: str, ordinal: str = "ordinal") -> DataFrame:
    """A packed Parquet layout with the place of each row in its order, from 1.

    The files follow each other in that order, and so do the rows of a file; what stands before a file is the sum of
    the rows of those before it, one number for each file.
    """
    counts = spark.read.parquet(f"{path}/{MANIFEST}").groupBy("file").agg(F.sum("rows").alias("rows")).collect()
    before, offsets = 0, []
    for file, rows in sorted((tuple(r) for r in counts), key=lambda r: (len(r[0]), r[0])):
        offsets.append((file, before))
        before += rows
    starts = F.broadcast(spark.createDataFrame(offsets, "_file string, _before bigint"))
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    return placed.join(starts, "_file").select((F.col("_before") + F.col("_index") + 1).alias(ordinal), *rows.columns)


def numbered(df: DataFrame, ties: tuple[str, ...] = (), layout: Layout = PATIENTS, ordinal: str = "ordinal") -> DataFrame:
    """Rows with their place in the order of entity, time and ``ties``: written packed to a shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/numbered-{uuid.uuid4()}"
    write_packed(df, path, layout=layout, ties=ties)
    return read_numbered(df.sparkSession, path, ordinal)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster names it in spark.checkpoint.dir. One of its own on one machine."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return folder


def write_by_day(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", layout: Layout = PATIENTS
) -> None:
    """One folder per calendar day, rows clustered by entity: the layout that later scans prune best."""
    when = _time_column(df, layout)
    dated = df.withColumn(DAY_FOLDER, F.to_date(when))
    spread = dated.repartitionByRange(DAY_FOLDER, layout.entity, when)
    _save(
        spread.sortWithinPartitions(DAY_FOLDER, layout.entity, when).write.mode(mode).partitionBy(DAY_FOLDER),
        path, fmt,
    )


def write_upload_ready(
    readings: DataFrame,
    events: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "errorifexists",
    layout: Layout = PATIENTS,
) -> None:
    """Readings with an event flag on the row nearest each event, in the form an upload is read from."""
    write_combined(flag_event_rows(readings, events, layout=layout), path, fmt, mode, layout)
