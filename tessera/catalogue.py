"""All registered queries, with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.queries import claims as _claims  # noqa: F401
from tessera.queries import contracts as _contracts  # noqa: F401
from tessera.queries import extraction as _extraction  # noqa: F401
from tessera.queries import graph as _graph  # noqa: F401
from tessera.queries import matching as _matching  # noqa: F401
from tessera.queries import places as _places  # noqa: F401
from tessera.queries import reporting
from tessera.queries import resolution as _resolution  # noqa: F401
from tessera.queries import search as _search  # noqa: F401
from tessera.queries import spatial as _spatial  # noqa: F401
from tessera.queries import streams as _streams  # noqa: F401
from tessera.queries import waterfall as _waterfall  # noqa: F401
from tessera.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.flagship(spark, sf_dir)
