"""Record identifiers.

They are derived from a key that is unique per input row (a source key, or file
and position) and the time stamp rather than drawn at random: two rows never share
one, and a recomputed task gives the same identifiers again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_id(collection: str, row_key: Column, moment: Column) -> Column:
    """UUID-shaped digest of collection, row key and arrival time."""
    digest = F.md5(F.concat_ws("|", F.lit(collection), row_key.cast("string"), moment.cast("string")))
    groups = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in groups])


def dated_id(prefix: str, key: Column, moment: Column) -> Column:
    """``PREFIX_yyyyMMddHHmmss_6HEX``."""
    suffix = F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 6))
    return F.concat_ws("_", F.lit(prefix), F.date_format(moment, "yyyyMMddHHmmss"), suffix)


def millis_id(prefix: str, moment: Column, row_key: Column) -> Column:
    """``PREFIX_<milliseconds since 1970>_<12HEX of the row key>``.

    ``moment`` is taken as UTC wall-clock time; the rows of a batch may share it.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    millis = F.timestamp_diff("MILLISECOND", epoch, moment.cast("timestamp_ntz"))
    suffix = F.upper(F.substring(F.sha2(row_key.cast("string"), 256), 1, 12))
    return F.concat_ws("_", F.lit(prefix), millis.cast("string"), suffix)
