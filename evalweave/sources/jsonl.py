"""JSON-lines files: knowledge bases, result files with a header line, logs with torn lines; and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KB_SCHEMA = "id string, kind string, dimension string, label string, lang string, text string, source string, meta string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): blank lines left out, line numbers by file, from 1.

    Large files are read in blocks. A line's number is its place in the block, as rows of a block come in order, and the
    number of lines in the blocks before it.
    """
    t = _lines(spark, path).withColumn("_at", F.monotonically_increasing_id())
    blocks = t.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    x = t.join(blocks, ["file", "_block"]).filter(F.trim("value") != "")
    return x.select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """Records with ``ord``, their place in the file; ``meta`` stays JSON text."""
    x = read_lines(spark, path).select("line_no", F.from_json("value", KB_SCHEMA).alias("r"))
    return x.select(F.col("line_no").alias("ord"), "r.*")


def read_results(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(header, rows) of result files: a line with ``_manifest`` is a header, torn lines are left out; ``run`` is the file's stem."""
    x = read_lines(spark, path).withColumn("v", F.try_parse_json("value")).filter("v is not null").withColumn("run", F.regexp_replace("file", r"\\.[^.]*$", ""))
    head = F.try_variant_get("v", "$._manifest", "string")
    rows = x.filter(head.isNull()).select("run", "line_no", F.from_json("value", schema).alias("r")).select("run", "line_no", "r.*")
    return x.filter(head.isNotNull()).select("run", head.alias("manifest")), rows


def last_line_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the one written last."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "line_no").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def line_quality(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_lines, n_parsed, n_corrupt): torn concurrent writes are counted, not fatal."""
    ok = F.try_parse_json("value").isNotNull()
    return _lines(spark, path).filter(F.trim("value") != "").groupBy("file").agg(F.count("*").alias("n_lines"), F.count(F.when(ok, 1)).alias("n_parsed"), F.count(F.when(~ok, 1)).alias("n_corrupt"))


def write_frozen(df: DataFrame, path: str, force: bool = False) -> None:
    """A split or subset that is not to change: an existing one is an error unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append only rows whose keys the table lacks, so a restarted run repeats nothing. Returns how many there were."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(*keys)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    new = df if have is None else df.join(have, keys, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def write_vectors(df: DataFrame, path: str, model: str, version: str) -> None:
    """A vector table with a sidecar that says what made it."""
    df.write.mode("overwrite").parquet(f"{path}/vectors")
    df.sparkSession.createDataFrame([(model, version)], "model string, version string").write.mode("overwrite").json(f"{path}/about")


def open_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The vector table, refused where another model made it."""
    made = spark.read.json(f"{path}/about").first()
    if made["model"] != model:
        raise ValueError(f"vectors are of {made['model']}, not of {model}")
    return spark.read.parquet(f"{path}/vectors")


def results_under(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of every run folder that matches a glob, with ``run`` (the folder's name) and its ``round``."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    x = spark.read.text(pattern).select(folder.alias("run"), "value").filter(F.try_parse_json("value").isNotNull())
    return x.select("run", round_of(F.col("run")).alias("round"), F.from_json("value", schema).alias("r")).select("run", "round", "r.*")


def discover(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, run, arm, round, n_lines) of result files that match a glob; names are ``{arm}_r{round}_...``."""
    x = _lines(spark, pattern).filter(F.trim("value") != "").groupBy("file").agg(F.count("*").alias("n_lines"))
    run = F.regexp_replace("file", r"\.[^.]*$", "")
    return x.select("file", run.alias("run"), F.regexp_extract(run, r"^(.*?)_r\d+_", 1).alias("arm"), round_of(run).alias("round"), "n_lines")


def round_of(name: Column) -> Column:
    """The round in a run's name, NULL without one."""
    return F.nullif(F.regexp_extract(name, r"_r(\d+)_", 1), F.lit("")).cast("int")


def write_sidecar(df: DataFrame, path: str) -> None:
    """A small result (metrics, histogram, sentinel) as JSON beside a run; one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def ledger(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of a Markdown table row for each row of ``df``; NULL as a dash."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
