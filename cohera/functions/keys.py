"""Deterministic pseudo-random keys.

All randomness in the package is a function of ``(seed, record id, ...)``
through md5, never ``rand()`` or ``shuffle()``: those depend on partition
layout, so a retried task could change the data. md5 is also available in
DuckDB, which lets the SQL oracle draw the very same shuffles and splits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BITS = 60  # 15 hex digits of the md5 digest


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def md5_key(*parts) -> Column:
    """md5 hex digest of the parts joined by ``|``."""
    return F.md5(F.concat_ws("|", *[_as_col(p) for p in parts]))


def key60(*parts) -> Column:
    """Uniform 60-bit non-negative BIGINT drawn from the md5 digest."""
    return F.conv(F.substring(md5_key(*parts), 1, 15), 16, 10).cast("bigint")
