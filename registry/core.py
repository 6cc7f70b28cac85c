"""Named queries with, where it exists, the same result as plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from tidegrid.fixtures import VIEWS, Fixtures, view_sql


class Query(NamedTuple):
    run: Callable[[Fixtures], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def with_views(sql: str) -> str:
    """Put the definitions of the views a query uses in front of it."""
    used = [name for name in VIEWS if name in sql]
    views = ", ".join(f"{name} AS ({view_sql(name)})" for name in used)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        rest = body[len("WITH RECURSIVE ") :]
        return f"WITH RECURSIVE {views}, {rest}" if views else body
    if body.startswith("WITH "):
        rest = body[len("WITH ") :]
        return f"WITH {views}, {rest}" if views else body
    return f"WITH {views} {body}" if views else body


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, whole numbers as BIGINT."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, IntegerType):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def add(name: str, run: Callable[[Fixtures], DataFrame], sql: str | None = None) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = Query(lambda fx: plain(run(fx)), with_views(sql) if sql else None)


def uniform_sql(*keys: str) -> str:
    """The same number as ``uniform_hash`` for keys written as SQL."""
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52})"


def normal_sql(*keys: str) -> str:
    """The same number as ``normal_hash``."""
    u1, u2 = uniform_sql(*keys, "'u1'"), uniform_sql(*keys, "'u2'")
    return f"(sqrt(-2.0 * ln(greatest({u1}, 1e-16::DOUBLE))) * cos(2.0 * pi() * {u2}))"


def pixels(fx: Fixtures) -> DataFrame:
    """Pixels with missing values as NULL: ``scene_id, r, c, vv, heat``."""
    return fx.pix.select(
        "scene_id",
        F.col("px_row").alias("r"),
        F.col("px_col").alias("c"),
        F.when(F.col("vv_db") != -32768, F.col("vv_db")).alias("vv"),
        "heat",
    )


PIXELS_SQL = (
    "SELECT scene_id, px_row AS r, px_col AS c, CASE WHEN vv_db <> -32768 THEN vv_db END AS vv, heat FROM pix_fx"
)
