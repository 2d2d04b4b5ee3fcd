"""A fixed-size bitmap that thins out rows before a join on their ids is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 8 MB, whatever the number of ids.
BITS = 1 << 26
_CHUNK = 1 << 15


def with_maybe(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df with a column `maybe`: whether the key may be among ids (one column of that name).

    True for every member, and for others with a chance of ids / BITS, so a
    join or semi-join on the key must follow where it is true.  The bitmap is
    built by an aggregate and broadcast; when there are very many ids it fills
    up and merely stops telling.  False for null keys.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))
    chunk, at = F.floor(place / _CHUNK).cast("int"), F.pmod(place, F.lit(_CHUNK))
    bitmap = ids.where(F.col(key).isNotNull()).select(chunk.alias("_chunk"), at.alias("_at")).groupBy("_chunk").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1, F.lit(False)) & F.col(key).isNotNull()
    placed = df.withColumn("_chunk", chunk).withColumn("_at", at)
    return placed.join(F.broadcast(bitmap), "_chunk", "left").withColumn("_byte", byte).select(*df.columns, is_set.alias("maybe"))


def maybe_members(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df that `with_maybe` lets through."""
    return with_maybe(df, key, ids).where("maybe").drop("maybe")
