"""Reading landed files: header aliases, file order, and the raw-record columns."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.functions.text import blank_to_null
from siteweave.schemas import as_raw_records

SEQ = "ingest_seq"


def with_file_order(rows: DataFrame) -> DataFrame:
    """Adds the position of a row in its files: stable however files are split into tasks."""
    return rows.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(SEQ),
    )


#: Files of one call; their list goes through the driver, as Spark's own file listing does.
MAX_FILES = 100_000
#: Different header lines that the files of one source may have.
MAX_HEADERS = 1000
MALFORMED = "_malformed"


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, quoted_breaks) of each file: its first line, and whether a quoted field runs over a line's end.

    Fields run over if some line holds an odd number of quotes.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        "value",
    )
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.max(quotes % 2 == 1).alias("quoted_breaks"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV, every column text; each file is read by its own header, whatever its order and spelling.

    Files are grouped by their first line and each group is read by name. Files with
    line breaks inside quotes are read whole (one task each), all others in
    splits. A row with more or fewer fields than its header keeps its line in
    ``_malformed``, and is null there otherwise (``malformed_rows`` counts them). With
    ``schema`` the result has its columns, missing ones null.
    """
    files = csv_files(spark, path).limit(MAX_FILES + 1).collect()
    if len(files) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files; read them folder by folder")
    groups: dict[tuple[str, bool], list[str]] = {}
    for row in sorted(files, key=lambda r: r["file"]):
        groups.setdefault((row["header"], row["quoted_breaks"]), []).append(unquote(row["file"]))
    if len(groups) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers")
    rows = None
    for (_, quoted_breaks), paths in groups.items():
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", bool(quoted_breaks))
        names = reader.csv(paths[0]).columns
        fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED]])
        part = with_file_order(reader.schema(fields).option("columnNameOfCorruptRecord", MALFORMED).csv(paths))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        rows = spark.createDataFrame([], f"{MALFORMED} string, {SEQ} struct<file:string,block:bigint,row:bigint>")
    if schema is None:
        return rows
    return rows.select(*[any_of(rows, f.name).alias(f.name) for f in schema.fields], MALFORMED, SEQ)


def malformed_rows(rows: DataFrame) -> DataFrame:
    """(file, malformed): rows of each file of ``read_csv`` that do not have their header's number of fields.

    All columns are read for it: a scan of some of them does not see how many a row has.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c not in (MALFORMED, SEQ)])
    marked = rows.select(F.col(f"{SEQ}.file").alias("file"), F.when(F.col(MALFORMED).isNotNull(), whole).alias("bad"))
    return marked.groupBy("file").agg(F.count("bad").alias("malformed"))


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """JSON objects or pages holding an array of them."""
    return with_file_order(spark.read.schema(schema).option("multiLine", multi_line).json(path))


def any_of(rows: DataFrame, *names: str) -> Column:
    """First filled value among the header spellings that exist; header case matters."""
    found = [blank_to_null(F.col(f"`{n}`")) for n in names if n in rows.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def finish(rows: DataFrame, source: str, run_id: str | None = None) -> DataFrame:
    """Raw records with a deterministic id: a rerun gives the same ids."""
    natural = F.coalesce(
        F.col("source_record_id"), F.concat_ws("\x1f", "raw_name", "raw_address", "raw_city", "raw_state")
    )
    return as_raw_records(
        rows.withColumns(
            {
                "source": F.lit(source),
                "source_run_id": F.lit(run_id).cast("string"),
                "id": F.sha2(F.concat_ws("\x1f", F.lit(source), natural), 256),
            }
        )
    )

