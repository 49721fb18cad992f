"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings.  Joins carry no broadcast hints, but for the offsets of the fold
# assignment, which have a fixed number of rows: Spark broadcasts a side only below a
# threshold, from file sizes before the run (see ``configure``) and from measured shuffle
# sizes during it.  A key that holds a large share of the rows
# is split by the adaptive skew join, also where that costs another exchange.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

STATIC = "spark.sql.autoBroadcastJoinThreshold"
MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"
# Bytes of compressed Parquet up to which a side is broadcast before anything is measured.
# Such estimates know neither the compression nor the rows that ``explode`` adds: a vocabulary
# made from 0.4 MB of a part table took 800 MB as a broadcast, which the driver builds.
ESTIMATED = 64 << 10


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings; the session's broadcast threshold then holds for measured sizes only.

    Estimated sizes have to stay below ``ESTIMATED``.  A lower threshold of the session, or
    none, is kept.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if threshold > ESTIMATED:
        if spark.conf.get(MEASURED, None) is None:
            spark.conf.set(MEASURED, str(threshold))
        spark.conf.set(STATIC, str(ESTIMATED))
    return spark
