"""Filtering by key without moving the rows that the filter leaves alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carry import carried, restored
from .store import saved

LEAST, MOST = 22, 26  #: the bitmap has 2^22 to 2^26 bits: a million rows of 16 bytes at most
PER_KEY = 16  #: bits for each key, while there is room


def _word(key: Column, bits: int) -> Column:
    return F.floor(F.pmod(F.xxhash64(key), F.lit(1 << bits)) / 64).cast("int")


def _mask(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))


def maybe_in(df: DataFrame, key: str, keys: DataFrame, name: str = "_maybe") -> DataFrame:  # df: an operator's own columns
    """df with a boolean that is true for every row whose key is in `keys` (a saved table with that column).

    It comes from a bitmap of hashed keys, sized by their number, that is broadcast; false answers are exact, true
    ones are to be checked by a join.  Beyond 2^MOST / PER_KEY keys (four million) it fills up; with some tens of
    millions nearly all rows are true and go through that join, as a plain semi-join would have them.
    """
    bits = min(MOST, max(LEAST, (keys.count() * PER_KEY).bit_length()))
    bitmap = saved(keys.select(_word(F.col(key), bits).alias("_word"), _mask(F.col(key)).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "bitmap")
    marked = df.withColumn("_word", _word(F.col(key), bits)).join(F.broadcast(bitmap), "_word", "left")
    return marked.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(_mask(F.col(key))) != 0, F.lit(False))).drop("_word", "_bits")


def without_keys(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in `dropped` (a saved table with the column `key`); null keys stay.

    Only rows whose bit is set are shuffled, to an exact anti-join that merges at any size.
    """
    gone = dropped.select(F.col(key).alias("_key"))
    marked = maybe_in(carried(df, _key=key), "_key", gone)
    checked = marked.where("_maybe").join(gone.hint("merge"), "_key", "left_anti")
    return marked.where("NOT _maybe").unionByName(checked).select(*restored(df))
