"""Random numbers that depend on a row's values alone, and that SQL can give too."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unit(*keys: Column | str) -> Column:
    """A number in (0, 1) from the MD5 digest of the keys, joined by colons; the same keys give the same number."""
    digits = F.substring(F.md5(F.concat_ws(":", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def unit_sql(*keys: str) -> str:
    """The same in SQL, of expressions."""
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
