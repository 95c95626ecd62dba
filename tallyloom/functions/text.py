"""String functions: Unicode white-space split, byte-sum partition ids, ordinals, truncated seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words.
WHITE_SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def split_words(text: Column) -> Column:
    """The non-empty words of a text as an array. Null text: null."""
    return F.filter(F.split(text, WHITE_SPACE, -1), lambda w: w != "")


def byte_sum(key: Column) -> Column:
    """Sum of the bytes of a string in UTF-8, 0 for an empty one: each byte as a character of one byte, then its code."""
    chars = F.split(F.decode(F.encode(key, "UTF-8"), "ISO-8859-1"), "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda total, c: total + F.ascii(c))


def partition_id(key: Column, partitions: int, is_text: bool = True) -> Column:
    """Partition of a key: its byte sum modulo the number of partitions; 0 for any key that isn't a string."""
    if partitions < 1:
        raise ValueError("partitions must be 1 at least")
    if not is_text:
        return F.lit(0)
    return (byte_sum(key) % partitions).cast("int")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, and th for all others (21th too: labels are compared with older ones, so they stay like that)."""
    return F.when(n == 1, "1st").when(n == 2, "2nd").when(n == 3, "3rd").otherwise(F.concat(n.cast("string"), F.lit("th")))


def seconds(t: Column) -> Column:
    """Seconds cut to three decimals."""
    return (t * 1000).cast("long") / 1000
