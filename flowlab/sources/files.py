"""Flow-record file sources: fixed-schema headerless CSV, split selection,
recursive CSV discovery with per-file bounded samples, dual-label parquet,
label-column resolution and file manifests.

Everything is a lazy Spark scan except the plan-time helpers that only look
at column names or file listings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.operators.label import BINARY_COLS, CATEGORICAL_COLS, add_category, attack_category
from flowlab.session import checkpoint_dir

# The 41 NSL-KDD features in file order, then label and difficulty.
NSL_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins",
    "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds",
    "is_host_login", "is_guest_login", "count", "srv_count", "serror_rate",
    "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
    "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate",
]
NSL_CATEGORICAL = CATEGORICAL_COLS
NSL_BINARY = BINARY_COLS
NSL_RATES = [c for c in NSL_FEATURES if c.endswith("_rate")]

# Candidate label column names, in priority order.
LABEL_COLUMN_CANDIDATES = ("label", "Label", "class", "Class", "attack", "Attack",
                           "Attack_type", "Attack Type")

# File name of each named NSL-KDD split.
NSL_SPLITS = {"train": "KDDTrain+.txt", "test": "KDDTest+.txt", "test-21": "KDDTest-21.txt",
              "train-20": "KDDTrain+_20Percent.txt"}


def nsl_schema() -> T.StructType:
    fields = []
    for c in NSL_FEATURES:
        if c in NSL_CATEGORICAL:
            t = T.StringType()
        elif c in NSL_BINARY:
            t = T.IntegerType()
        elif c in NSL_RATES:
            t = T.DoubleType()
        else:
            t = T.LongType()
        fields.append(T.StructField(c, t, True))
    fields += [T.StructField("label", T.StringType(), True),
               T.StructField("difficulty", T.IntegerType(), True)]
    return T.StructType(fields)


def read_headerless_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                        sep: str = ",") -> DataFrame:
    """Fixed-schema, header-less CSV; malformed rows fail the job (FAILFAST)."""
    return (spark.read.schema(schema or nsl_schema()).option("header", "false")
            .option("sep", sep).option("mode", "FAILFAST").csv(path))


def split_path(root: str, split: str, splits: dict[str, str] | None = None) -> str:
    """Path of a named split; unknown names are an error."""
    s = splits or NSL_SPLITS
    if split not in s:
        raise ValueError(f"split must be one of {list(s)}, got {split!r}")
    return f"{root.rstrip('/')}/{s[split]}"


def load_split(spark: SparkSession, root: str, split: str, splits: dict[str, str] | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    return read_headerless_csv(spark, split_path(root, split, splits), schema)


def find_label_column(columns: list[str]) -> str:
    """Exact candidate first (in priority order), then a case-insensitive match."""
    for c in LABEL_COLUMN_CANDIDATES:
        if c in columns:
            return c
    lower = {}
    for c in columns:
        lower.setdefault(c.lower(), c)
    for c in LABEL_COLUMN_CANDIDATES:
        if c.lower() in lower:
            return lower[c.lower()]
    raise KeyError(f"no label column among {columns}; expected one of {LABEL_COLUMN_CANDIDATES}")


def strip_header(df: DataFrame) -> DataFrame:
    """Trim whitespace around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv_tree(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Every ``*.csv`` below ``root`` (file or directory), with a header row,
    plus ``source_file``.  No file is an error."""
    r = (spark.read.option("header", "true").option("recursiveFileLookup", "true")
         .option("pathGlobFilter", "*.csv"))
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", "true")
    try:
        df = r.csv(root)
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for empty paths
        raise FileNotFoundError(f"no CSV files under {root}") from e
    df = strip_header(df)
    return (df.withColumn("source_path", F.col("_metadata.file_path"))
            .withColumn("source_file", F.element_at(F.split(F.col("source_path"), "/"), -1)))


def csv_files(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, source_file, rows) of every CSV below ``root``."""
    return read_csv_tree(spark, root).groupBy("source_path", "source_file").agg(
        F.count(F.lit(1)).alias("rows"))


def load_csv_sample(spark: SparkSession, root: str, max_rows_per_file: int, key: str | None = None,
                    schema: T.StructType | None = None, label_col: str | None = None) -> DataFrame:
    """At most ``max_rows_per_file`` rows of each CSV below ``root``, labelled.

    "First n lines" is not a distributed notion, so each file keeps the n rows
    with the smallest hash of ``key`` (default: a hash of the whole row); the
    per-file ranking is the skew-safe bucketed one of ``sample.ranked_within``.
    """
    from flowlab.operators.sample import ranked_within
    df = read_csv_tree(spark, root, schema)
    k = key or "_row_hash"
    if key is None:
        # 62 bits: rows that tie are equal rows, so the sample does not vary
        df = df.withColumn("_row_hash", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1 << 62)))
    counts = {r[0]: min(int(r[1]), max_rows_per_file)
              for r in df.groupBy("source_path").count().collect()}  # one row per file
    out = ranked_within(df, "source_path", k, 0, counts).drop("rank_in_class", "source_path")
    if key is None:
        out = out.drop("_row_hash")
    lab = label_col or find_label_column([c for c in out.columns if c not in ("source_file",)])
    if lab != "label":
        out = out.withColumnRenamed(lab, "label")
    return add_category(out, "label")


def read_dual_label_parquet(spark: SparkSession, path: str, fine: str = "Label",
                            binary: str = "label", drop: tuple[str, ...] = ("attack_class",)) -> DataFrame:
    """Parquet holding both ``Label`` (fine) and ``label`` (0/1).

    Read by a session of its own in which names are case-sensitive (else the
    two collide) and renamed there; ``attack_category`` is re-derived from the
    fine label.  Nothing is copied, and the caller's setting is not touched.
    """
    exact = spark.newSession()
    exact.conf.set("spark.sql.caseSensitive", "true")
    raw = exact.read.parquet(path)
    feats = [c for c in raw.columns if c not in (fine, binary, *drop)]
    out = raw.select(*[F.col(f"`{c}`") for c in feats], F.trim(F.col(f"`{fine}`").cast("string")).alias("label"),
                     F.col(f"`{binary}`").cast("int").alias("binary_label"))
    # eager unknown-label check runs on the distinct labels only
    add_category(out.select("label").distinct(), "label")
    return out.withColumn("attack_category", attack_category(F.col("label")))


def text_manifest(spark: SparkSession, root: str, sep: str = ",", header: bool = True,
                  glob: str = "*") -> DataFrame:
    """(file_name, rows, columns) for delimited text files under ``root``.

    Rows are non-blank data lines (the header, the first non-blank line, excluded);
    columns = separators in that line + 1.  An empty file has 0 rows and 0 columns.
    One scan, aggregated per file, and a listing for the files without a line.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
              .load(root).select(F.col("path").alias("file_path")))
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
             .text(root).select(F.col("_metadata.file_path").alias("file_path"),
                                F.col("_metadata.file_block_start").alias("_blk"),
                                F.monotonically_increasing_id().alias("_id"), "value"))
    first = lines.where(F.trim("value") != "").groupBy("file_path").agg(
        F.min_by("value", F.struct("_blk", "_id")).alias("_first"), F.count(F.lit(1)).alias("_nonblank"))
    rows = F.coalesce(F.col("_nonblank") - (1 if header else 0), F.lit(0)).cast("long")
    columns = F.when(F.col("_first").isNull(), 0).otherwise(F.size(F.split(F.col("_first"), _regex_quote(sep))))
    path = F.regexp_replace("file_path", "^file:/+", "file:/")
    return (listed.select(path.alias("file_path")).join(first.withColumn("file_path", path), "file_path", "left")
            .select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), rows.alias("rows"),
                    columns.cast("int").alias("columns")))


def _regex_quote(s: str) -> str:
    import re
    return re.escape(s)


def file_digests(spark: SparkSession, root: str, glob: str = "*",
                 max_bytes: int = 2_000_000_000) -> DataFrame:
    """(file_name, bytes, sha256) for files under ``root``.

    ``binaryFile`` loads a whole file into one row, so a file over ``max_bytes``
    raises, by name, before anything is read.
    """
    b = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
         .option("pathGlobFilter", glob).load(root))
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    large = b.where(F.col("length") > max_bytes).select("path")
    if n := large.count():
        raise ValueError(f"{n} files over {max_bytes} bytes have no digest, first {large.orderBy('path').first()[0]}")
    return b.select(name.alias("file_name"), F.col("length").alias("bytes"), F.sha2(F.col("content"), 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Left join expected (file_name, rows, columns[, sha256]) to the observed manifest
    and flag each expectation: ok / missing / rows / columns / sha256."""
    e = expected.alias("e")
    m = manifest.alias("m")
    j = e.join(m, F.col("e.file_name") == F.col("m.file_name"), "left")
    status = (F.when(F.col("m.file_name").isNull(), "missing")
              .when(F.col("e.rows") != F.col("m.rows"), "rows")
              .when(F.col("e.columns") != F.col("m.columns"), "columns"))
    if "sha256" in expected.columns and "sha256" in manifest.columns:
        status = status.when(F.col("e.sha256") != F.col("m.sha256"), "sha256")
    return j.select(F.col("e.file_name").alias("file_name"), F.col("e.rows").alias("expected_rows"),
                    F.col("m.rows").alias("rows"), status.otherwise("ok").alias("status"))


def assign_roles(manifest: DataFrame, expected_rows: dict[int, str]) -> DataFrame:
    """Role of each file from its row count (mirrors may mislabel files); unknown = null."""
    dim = manifest.sparkSession.createDataFrame(list(expected_rows.items()), "rows long, role string")
    return manifest.join(F.broadcast(dim), "rows", "left").select("file_name", "rows", "columns", "role")


def column_count_consistency(manifest: DataFrame) -> DataFrame:
    """One row: distinct column counts across files, consistent flag and total rows."""
    return manifest.agg(F.count_distinct("columns").alias("distinct_column_counts"),
                        (F.count_distinct("columns") == 1).alias("consistent"),
                        F.sum("rows").alias("total_rows"), F.count(F.lit(1)).alias("files"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a machine-local tmp)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/flowlab-{name}-{uuid.uuid4().hex[:12]}"
