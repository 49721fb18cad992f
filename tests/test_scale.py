"""Plans over tables whose size can't be told from their files."""

from pyspark.sql import functions as F

from cohortloom.session import ESTIMATED, MEASURED, STATIC, configure
from cohortloom.suite.registry import QUERIES


def plain_session(spark, threshold):
    session = spark.newSession()
    session.conf.set(STATIC, threshold)
    return session


def test_vocabularies_are_not_broadcast_by_file_size(spark, tmp_path):
    """Parts explode to many rows, which the size of their file does not tell."""
    key = F.col("id").cast("string")
    parts = spark.range(200_000).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("part "), key).alias("p_name"),
        F.concat(F.lit("Brand#"), (F.col("id") % 25 + 1).cast("string")).alias("p_brand"),
        F.lit("LARGE").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"),
        F.lit(1.0).alias("p_retailprice"))
    parts.write.parquet(str(tmp_path / "part.parquet"))
    session = plain_session(spark, "10m")
    for name in ("find_concepts_ids", "make_tree", "make_tree_proc", "expand_codeset", "descendant_summary"):
        plan = QUERIES[name](session, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan, name
    # Source concepts and the leaves that map back, without invalid ones.
    found = QUERIES["find_concepts_ids"](session, str(tmp_path))
    assert found.count() == 200_000 - 200_000 // 10 + 200_000


def test_thresholds_of_the_session_are_kept(spark):
    session = configure(configure(plain_session(spark, "20m")))
    assert session.conf.get(STATIC) == str(ESTIMATED) and session.conf.get(MEASURED) == str(20 << 20)
    for low in ("1000", "-1"):
        session = configure(plain_session(spark, low))
        assert session.conf.get(STATIC) == low and session.conf.get(MEASURED, None) is None
