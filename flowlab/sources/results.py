"""Result-table sinks and readers: CSV/parquet result tables, the JSON run log,
and pipe-delimited (markdown) result tables with section headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("task", T.StringType()), T.StructField("model_family", T.StringType()),
    T.StructField("run_name", T.StringType()), T.StructField("seed", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("artifacts", T.MapType(T.StringType(), T.StringType())),
    T.StructField("notes", T.StringType()), T.StructField("started_at", T.StringType()),
])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True) -> str:
    """Overwrite a result table (parquet or CSV with header)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", str(header).lower()).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def append_runs(runs: DataFrame, path: str) -> str:
    """Append run records (one JSON object per line) to the run log folder."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in runs.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in RUN_SCHEMA.fields]
    runs.select(*cols).write.mode("append").json(path)
    return path


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log with its declared schema; an absent log is an empty table."""
    try:
        return spark.read.schema(RUN_SCHEMA).json(path)
    except Exception as e:  # noqa: BLE001 - AnalysisException: path does not exist
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], RUN_SCHEMA)
        raise


def markdown_lines(df: DataFrame, section: str, columns: list[str], fmt: dict[str, str] | None = None
                   ) -> DataFrame:
    """Render a (small) result table as markdown lines ``(section, pos, line)``:
    a ``## section`` heading, the header, the rule, then one pipe row per row."""
    fmt = fmt or {}
    cells = [F.format_string(fmt[c], F.col(c)) if c in fmt else F.col(c).cast("string") for c in columns]
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"),
                     *[F.col(c).alias(f"_o{i}") for i, c in enumerate(columns)])
    spark = df.sparkSession
    head = spark.createDataFrame([(0, f"## {section}"), (1, "| " + " | ".join(columns) + " |"),
                                  (2, "|" + "---|" * len(columns))], "pos int, line string")
    rows = body.select(F.lit(3).alias("pos"), "line")
    return head.unionByName(rows).select(F.lit(section).alias("section"), "pos", "line")


def read_pipe_tables(spark: SparkSession, path: str, n_cells: int | None = None) -> DataFrame:
    """Pipe-delimited tables under ``path`` → (source_file, section, cells array).

    With ``n_cells``, a column ``odd`` marks the rows that have another number
    of cells.  Lines are read in file order (file, block, position); each line takes the
    nearest preceding ``## `` heading of its file as ``section``; header and
    rule lines (bars, dashes, colons and blanks only) are skipped.  The heading lookup is a window per file — report
    files are small by construction.
    """
    lines = spark.read.text(path).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    order = Window.partitionBy("source_file").orderBy("_blk", "_id")
    heading = F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1 << 20)))
    x = lines.withColumn("section", F.last(heading, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = x.where(F.col("line").startswith("|") & ~F.col("line").rlike(r"^[|:\s-]*-[|:\s-]*$")
                   & F.col("section").isNotNull())
    # the first pipe line after each heading is the table header
    rows = rows.withColumn("_r", F.row_number().over(
        Window.partitionBy("source_file", "section").orderBy("_blk", "_id"))).where(F.col("_r") > 1)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"),
                        lambda c: F.trim(c))
    out = rows.select("source_file", "section", cells.alias("cells"))
    if n_cells is not None:
        out = out.withColumn("odd", F.size("cells") != n_cells)
    return out
