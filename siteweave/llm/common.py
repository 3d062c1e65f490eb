"""Helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are worked on at once; keeps a task's memory to a few megabytes of text.
SLICE = 256

#: Public tokenizer files; every operator that reads one takes its path as a parameter.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_siteweave_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(archive)
    context._siteweave_shipped = True


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def unused(name: str, taken: Iterable[str]) -> str:
    """The name, or with marks before it one that no column has."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def hash_share(key: Column, wanted: int, total: int, salt: int) -> Column:
    """True for about ``wanted`` of ``total`` keys, by a hash of the key: the same keys on every run."""
    if total <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40)) < int((1 << 40) * (wanted / total))


def hinted(df: DataFrame, most_rows: int) -> DataFrame:
    """With a broadcast hint if a count shows that it has ``most_rows`` rows at most; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() <= most_rows else df
