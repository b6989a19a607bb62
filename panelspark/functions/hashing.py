"""A number in [0, 1) from key columns and a seed: the basis of all repeatable sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(keys: list[str], seed: int) -> Column:
    """32 bits of an md5 over the keys, joined with ``|``, and the seed.

    Equal on every partitioning and in every engine that has md5.  Null keys are left out.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0
