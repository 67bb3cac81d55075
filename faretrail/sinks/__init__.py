"""Sinks K1-K5.

Every writer runs on the executors; nothing is gathered on the driver and no
report is built as one value. Ordered output (JSON documents, indexed files)
is dealt by ranges of its order, so a report of any size is written by many
tasks.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize_at, release

OPEN, CLOSE = '{"Info":[', "]}"
_FILE, _ROW, _PART, _BEFORE = "__file", "__row", "__part", "__before"


def numbered(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = (),
             index_col: str = "row") -> tuple[DataFrame, str]:
    """``df`` with the 1-based place of each row in ``order_by`` order, within
    each non-null ``by`` key, and the folder of the table it is read from.

    The rows are written once and dealt by ranges of (``by``, ``order_by``);
    a row's place is its place in its range plus the rows of the ranges
    before it. Rows equal in all of these are told apart by their place in the
    written files, so equal rows also spread over ranges and no key or value
    is held by one task. Only one count per key and range is ordered globally.
    """
    spark = df.sparkSession
    kept, first = materialize_at(df, "rows")
    places = [F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW)]
    order = [*order_by, _FILE, _ROW]
    dealt = kept.select(*kept.columns, *places).repartitionByRange(*[F.col(c) for c in (*by, *order)])
    ranged, path = materialize_at(dealt.withColumn(_PART, F.spark_partition_id()), "ranges")
    release(spark, [first])
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*by, _PART).agg(F.count(F.lit(1)).alias("__n")).select(
        *by, _PART, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(_BEFORE))
    in_range = Window.partitionBy(*by, _PART).orderBy(*[F.col(c) for c in order])
    out = ranged.withColumn(index_col, F.row_number().over(in_range).cast("long")).join(before, [*by, _PART])
    return out.select(*df.columns, (F.col(index_col) + F.col(_BEFORE)).alias(index_col)), path


def _json_line(cols: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in cols])).alias("line")


def document_rows(lines: DataFrame, names: Sequence[str], name_col: str = "report",
                  order_by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """K1 as rows (report, position, line) that read in order give one
    ``{"Info":[...]}`` document per declared name, and the folder they are
    read from.

    Position 0 opens a document and the last position closes it; a declared
    report without records is an empty document. Records are in ``order_by``
    order, ties and the default by their JSON text. A record of an undeclared
    report raises.
    """
    placed, path = numbered(lines, [*order_by, "line"], by=[name_col], index_col="position")
    text = F.when(F.col("position") > 1, F.concat(F.lit(","), "line")).otherwise(F.col("line"))
    undeclared = F.raise_error(F.concat(F.lit("undeclared report: "), F.col(name_col))).cast("string")
    records = placed.select(
        name_col, "position", F.when(F.col(name_col).isin(list(names)), text).otherwise(undeclared).alias("line"))
    declared = lines.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias(name_col))
    sizes = placed.groupBy(name_col).agg(F.max("position").alias("__n"))
    ends = declared.join(sizes, name_col, "left").select(name_col, F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("position"), F.lit(OPEN).alias("line")),
        F.struct((F.coalesce("__n", F.lit(0)) + 1).alias("position"), F.lit(CLOSE).alias("line")),
    )))
    return records.unionByName(ends), path


def _in_order(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt by ranges and sorted: part files in name order are in order."""
    return rows.repartitionByRange(*[F.col(c) for c in cols]).sortWithinPartitions(*cols)


def write_info_json(df: DataFrame, path: str, mode: str = "errorifexists",
                    order_by: Sequence[str] = (), record_cols: Sequence[str] | None = None) -> None:
    """K1 for one report: a folder whose text parts, in name order, are the
    document (a report below one range is one part). Null fields are left out
    of each record (as ``toJSON``); ``record_cols`` limits the fields written
    (the order may use others)."""
    order = [f"__order{i}" for i in range(len(order_by))]
    lines = df.select(F.lit("report").alias("report"), *[F.col(c).alias(o) for c, o in zip(order_by, order)],
                      _json_line(record_cols or df.columns))
    rows, kept = document_rows(lines, ["report"], order_by=order)
    _in_order(rows, "position").select("line").write.mode(mode).text(path)
    release(df.sparkSession, [kept])


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1 for large reports: one JSON record per line, written in parallel."""
    df.write.mode(mode).json(path)


def write_delimited(df: DataFrame, path: str, sep: str = "|", single_file: bool = False,
                    mode: str = "errorifexists", header: bool = True) -> None:
    """K2: delimited text with a header. ``single_file`` shuffles the final
    rows into one partition (``repartition(1)``, so the work above still runs
    in parallel; ``coalesce(1)`` would narrow the whole last stage)."""
    out = df.repartition(1) if single_file else df
    out.write.mode(mode).option("header", header).option("sep", sep).csv(path)


def with_row_index(df: DataFrame, order_by: Sequence[str], index_col: str = "row") -> DataFrame:
    """1-based row number in ``order_by`` order, first column (``numbered``)."""
    out, _ = numbered(df, order_by, index_col=index_col)
    return out.select(index_col, *df.columns)


def write_indexed_csv(df: DataFrame, path: str, order_by: Sequence[str], index_col: str = "row",
                      mode: str = "errorifexists") -> None:
    """K3: comma-separated file with a 1-based row index first (R's write.csv);
    parts in name order are in row order."""
    out, kept = numbered(df, order_by, index_col=index_col)
    _in_order(out, index_col).select(index_col, *df.columns).write.mode(mode).option("header", True).csv(path)
    release(df.sparkSession, [kept])


def report_lines(results: Mapping[str, DataFrame], name_col: str = "report") -> DataFrame:
    """Many reports with different columns as one table of (report, JSON record)."""
    out = None
    for name, df in results.items():
        lines = df.select(F.lit(name).alias(name_col), _json_line(df.columns))
        out = lines if out is None else out.unionByName(lines)
    return out


def write_info_documents(results: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists",
                         name_col: str = "report") -> str:
    """K1 for many reports at once: the parts of ``folder/report=<name>/``, in
    name order, are that report's document.

    Every report is its own union branch here; ``JourneySuite.document_lines``
    gives one branch per shared aggregate instead.
    """
    return write_documents_from_lines(report_lines(results, name_col), folder, list(results), mode, name_col)


def write_documents_from_lines(lines: DataFrame, folder: str, names: Sequence[str], mode: str = "errorifexists",
                               name_col: str = "report") -> str:
    """K1 from a (report, line) table: one document per declared name under
    ``folder/report=<name>/``, ``{"Info":[]}`` for a report without lines."""
    rows, kept = document_rows(lines, names, name_col)
    _in_order(rows, name_col, "position").select(name_col, "line").write.mode(mode).partitionBy(name_col).text(folder)
    release(lines.sparkSession, [kept])
    return folder


#: What a Hadoop file system answers if it can join files without moving bytes.
_CONCAT = "fs.capability.paths.concat"


def one_file(spark: SparkSession, folder: str, target: str) -> str:
    """K1/K2: the text parts of ``folder``, in name order, as the one file
    ``target``, as the reference writes each report; the folder is deleted.

    The parts are written by many tasks. Where the store can concatenate (HDFS)
    they are joined by its metadata and no byte moves. Elsewhere one task
    streams them in order (sorted by file and place, so it may spill, and never
    holds the file); nothing passes through the driver. A folder without
    parts gives an empty file; an existing ``target`` raises.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(folder).getFileSystem(conf)
    if fs.exists(path(target)):
        raise FileExistsError(target)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(path(folder))
                   if s.getPath().getName().startswith("part-") and s.getLen())
    if len(parts) > 1 and not fs.hasPathCapability(path(folder), _CONCAT):
        place = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                 F.monotonically_increasing_id().alias("__row")]  # rising within a block
        lines = spark.read.option("lineSep", "\n").text(folder).select("value", *place)
        joined = folder.rstrip("/") + ".joined"
        lines.repartition(1).sortWithinPartitions("__file", "__block", "__row").select("value").write.option("lineSep", "\n").text(joined)
        release(spark, [folder])
        folder = joined
        parts = [s.getPath().toString() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-")]
    fs.mkdirs(path(target).getParent())
    if not parts:
        fs.create(path(target)).close()
    elif not fs.rename(path(parts[0]), path(target)):
        raise OSError(f"cannot rename {parts[0]} to {target}")
    if len(parts) > 1:
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
        for i, p in enumerate(parts[1:]):
            rest[i] = path(p)
        fs.concat(path(target), rest)
    release(spark, [folder])
    return target


def save_results(results: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> dict[str, str]:
    """K5: every named result as Parquet under ``folder/<name>``."""
    written = {}
    for name, df in results.items():
        path = os.path.join(folder, name)
        df.write.mode(mode).parquet(path)
        written[name] = path
    return written
