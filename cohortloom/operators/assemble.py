"""Model input: long feature rows, shared features, labels, scaling, sparse vectors."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.distributed import union_all, vocabulary

# Feature blocks with counts rather than 0/1 flags; their column sets are closed.
COUNT_DOMAINS = ("util", "lab_cts")
AGE_KEY = "entry_age"
# Prefixes of one-hot demographic columns.
ONE_HOT = {"site": "site", "sex": "sex_cat", "eth": "eth_cat",
           "cohort_entry": "cohort_entry_period"}


def one_hot_demo(cohort: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(person, key, value) rows for every demographic level and the entry age.

    All levels are kept; a null gives no row.  ``carry`` names cohort columns to keep.
    """
    flags = [F.struct(F.concat(F.lit(prefix + "_"), F.col(col)).alias("feature_key"),
                      F.lit(1.0).alias("value")) for prefix, col in ONE_HOT.items()]
    age = F.struct(F.lit(AGE_KEY).alias("feature_key"),
                   F.col("entry_age").cast("double").alias("value"))
    return (cohort.select("person_id", *carry, F.explode(F.array(*flags, age)).alias("f"))
            .select("person_id", *carry, "f.feature_key", "f.value")
            .filter(F.col("feature_key").isNotNull() & F.col("value").isNotNull()))


def assemble_long(cohort: DataFrame, blocks: Mapping[str, DataFrame],
                  carry: Sequence[str] = ()) -> DataFrame:
    """(person, domain, key, value) of demographics and all feature blocks.

    Every block covers the whole cohort, absent rows being zeros, so the inner
    merge of blocks on person is a union here.  A stacked block brings its own
    ``domain`` column, and ``carry`` names cohort columns all blocks have kept,
    such as the fold, so that none has to be joined back.
    """
    parts = {"demo": one_hot_demo(cohort, carry), **blocks}
    return union_all([
        df.select("person_id", *carry,
                  (F.col("domain") if "domain" in df.columns else F.lit(name)).alias("domain"),
                  "feature_key", F.col("value").cast("double").alias("value"))
        for name, df in parts.items()])


def common_features(train: DataFrame, test: DataFrame) -> DataFrame:
    """Feature keys present in both sets."""
    return (train.select("feature_key").distinct()
            .join(test.select("feature_key").distinct(), "feature_key", "left_semi"))


def drop_diff(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sets restricted to their common features."""
    shared = common_features(train, test)
    return (train.join(shared, "feature_key", "left_semi"),
            test.join(shared, "feature_key", "left_semi"))


def label3() -> Column:
    """0 control, 1 diagnosis B, 2 diagnosis A only."""
    return (F.col("pasc_flag") + F.col("pasc_not_misc_flag")).cast("int")


def feature_stats(long: DataFrame, persons: DataFrame) -> DataFrame:
    """Mean and population deviation per feature over all persons, zeros included.

    A constant feature gets deviation 1, so it scales to 0.
    """
    n = persons.select("person_id").distinct().agg(F.count("*")).scalar()
    mean = F.sum("value") / n
    variance = F.greatest(F.sum(F.col("value") * F.col("value")) / n - mean * mean, F.lit(0.0))
    sd = F.sqrt(variance)
    return (long.groupBy("feature_key")
            .agg(mean.alias("mean"), F.when(sd > 1e-12, sd).otherwise(1.0).alias("sd"))
            .withColumn("zero_value", -F.col("mean") / F.col("sd")))


def scale(long: DataFrame, stats: DataFrame) -> DataFrame:
    """z-scores of the stored (non-zero) entries; ``zero_value`` of the statistics is the rest.

    The statistics hold one row per feature.
    """
    return (long.join(stats, "feature_key")
            .withColumn("value", (F.col("value") - F.col("mean")) / F.col("sd"))
            .select(*long.columns))


def vector_layout(long: DataFrame) -> tuple[list[str], list[str]]:
    """(flag keys, count keys): the vector slots in order.

    Their number follows the vocabulary and the windows, not the persons.
    """
    counted = F.col("domain").isin(*COUNT_DOMAINS) | (F.col("feature_key") == AGE_KEY)
    return (vocabulary(long.filter(~counted), "feature_key"),
            vocabulary(long.filter(counted), "feature_key"))


def feature_vectors(cohort: DataFrame, long: DataFrame, flag_keys: Sequence[str],
                    count_keys: Sequence[str]) -> DataFrame:
    """One sparse vector per cohort member: flags by vocabulary, counts as numeric columns.

    Cohort rows join the feature rows by union, so a person without features
    stays and one shuffle on the person does everything.  A person's key set
    is bounded by the vocabulary.
    """
    slots = [f"count_{i}" for i in range(len(count_keys))]
    carried = [c for c in ("fold", "label") if c in cohort.columns]
    members = cohort.select("person_id", *carried)
    rows = union_all([members, long.select("person_id", "feature_key", "value")],
                     allow_missing=True)
    counted = F.col("feature_key").isin(*count_keys) if count_keys else F.lit(False)
    grouped = rows.groupBy("person_id").agg(
        *[F.max(c).alias(c) for c in carried],
        F.sort_array(F.collect_set(F.when(~counted & (F.col("value") != 0),
                                          F.col("feature_key")))).alias("tokens"),
        *[F.coalesce(F.max(F.when(F.col("feature_key") == k, F.col("value"))), F.lit(0.0))
          .alias(slot) for k, slot in zip(count_keys, slots)])
    if carried:  # feature rows of persons outside the cohort carry nothing
        grouped = grouped.filter(F.col(carried[0]).isNotNull())
    inputs = list(slots)
    if flag_keys:
        vectorizer = CountVectorizerModel.from_vocabulary(
            list(flag_keys), inputCol="tokens", outputCol="flags").setBinary(True)
        grouped = vectorizer.transform(grouped)
        inputs = ["flags", *slots]
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(grouped)
    return assembled.select("person_id", *carried, "features")


def make_feature_df(cohort: DataFrame, blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Vectors and 3-class label straight from the cohort and its feature blocks."""
    long = assemble_long(cohort, blocks)
    flag_keys, count_keys = vector_layout(long)
    return feature_vectors(cohort.withColumn("label", label3().cast("double")), long,
                           flag_keys, count_keys)
