"""Pseudorandom numbers that depend on a row's key alone, so that reruns and rows dealt differently agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, *salt: int) -> Column:
    """A number between 0 and 1, neither included, from the first 52 bits of the MD5 sum of the salt and the key.

    The text that is hashed joins salt and key by colons; a null key is empty text.
    """
    text = F.concat(F.lit("".join(f"{s}:" for s in salt)), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("double") + 0.5) / float(1 << 52)
