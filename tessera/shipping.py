"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROWS = 512
PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-package-")) / "tessera_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context._tessera_shipped = True


def map_in_arrow(df: DataFrame, function: Callable, schema, rows: int = ROWS) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, in slices of at most ``rows`` rows.

    What a function makes of a slice stays small in a worker, however many rows Spark puts in a batch. Functions go by the
    places of columns: names with dots, which Spark would take for fields here, are replaced on the way in.
    """
    ship(df.sparkSession)
    if any("." in c or "`" in c for c in df.columns):
        df = df.toDF(*(f"_{i}_of_{len(df.columns)}_" for i in range(len(df.columns))))

    def sliced(batches: Iterator) -> Iterator:
        yield from function(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return df.mapInArrow(sliced, schema)
