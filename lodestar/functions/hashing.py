"""Reproducible randomness: uniforms and orders from md5 of a seed and the entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def order_key(*parts) -> Column:
    return F.md5(_text(parts))


def uniform(*parts) -> Column:
    """In [0, 1), from the first 32 bits."""
    return F.conv(F.substring(F.md5(_text(parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def order_sql(*parts: str) -> str:
    """The same for DuckDB; parts are SQL expressions."""
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def uniform_sql(*parts: str) -> str:
    return f"(cast('0x' || substr({order_sql(*parts)}, 1, 8) AS bigint) / 4294967296.0)"
