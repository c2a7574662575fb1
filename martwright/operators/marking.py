"""Rows that may have a key of another table, marked where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_ROW, MOST_BITS = 16, 1 << 26


def perhaps_in(
    df: DataFrame, key: list[Column], few: DataFrame, few_key: list[Column], most_bits: int = MOST_BITS
) -> DataFrame:
    """``df`` with ``_perhaps``, which is false only for rows whose key no row of ``few`` has.

    Rows that are not marked need no join with ``few``, and so no shuffle. Keys are hashed to the bits
    of a bitmap of at most ``most_bits``, which all tasks are sent; the more ``few`` outgrows it, the
    more rows are marked without a match. Nulls are equal. Both keys must have the same types, and
    ``few`` should be stored, as it is read twice.
    """
    bits = F.lit(min(most_bits, BITS_A_ROW * max(1, few.count())))
    place = few.select(F.pmod(F.xxhash64(*few_key), bits).alias("_place"))
    bitmap = place.groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bitmap")
    )
    at = F.bitmap_bit_position("_place")
    # The byte that holds the bit; null where the bucket is empty.
    byte = F.substring("_bitmap", F.shiftright(at, 3).cast("int") + 1, 1)
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    is_set = F.call_function("getbit", number, at.bitwiseAND(7).cast("int")) == 1
    placed = df.withColumn("_place", F.pmod(F.xxhash64(*key), bits))
    return (
        placed.join(F.broadcast(bitmap), F.bitmap_bucket_number("_place") == F.col("_bucket"), "left")
        .withColumn("_perhaps", F.coalesce(is_set, F.lit(False)))
        .drop("_place", "_bucket", "_bitmap")
    )
