"""De-identification: nonce ids, ages instead of dates, site labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.distributed import row_numbers
from cohortloom.operators.columns import drop_matching, mutate_matching, rename_matching


def distinct_ct(df: DataFrame, id_col: str = "person_id") -> DataFrame:
    """Number of distinct values as one row; null counts as a value."""
    return df.select(id_col).distinct().agg(F.count("*").alias("dist_ct"))


def gen_xwalk(df: DataFrame, id_col: str, rep_col: str = "seq_id") -> DataFrame:
    """Distinct ids numbered 1..n in id order."""
    return row_numbers(df.select(id_col).distinct(), [F.asc(id_col)], rep_col)


def new_id(data: DataFrame, id_col: str, xwalk: DataFrame | None = None,
           replace: bool = False) -> DataFrame:
    """Add the crosswalk columns, or put the first of them in place of the id."""
    xwalk = gen_xwalk(data, id_col) if xwalk is None else xwalk
    joined = data.join(xwalk, id_col, "left")
    if not replace:
        return joined
    new_col = next(c for c in xwalk.columns if id_col not in c)
    return joined.drop(id_col).withColumnRenamed(new_col, id_col)


def dates_to_ages(df: DataFrame, person: DataFrame) -> DataFrame:
    """Every ``x_date`` becomes ``x_age`` in days since birth; dates and times are dropped.

    A frame without any date column is returned untouched, and the birth date
    itself is not turned into an age.
    """
    if not any("_date" in c for c in df.columns):
        return df
    if "birth_date" in df.columns:
        born = df.withColumn("_birth", F.to_date("birth_date")).drop("birth_date")
    else:
        if "birth_datetime" not in df.columns:
            df = df.join(person.select("person_id", "birth_datetime"), "person_id")
        born = df.withColumn("_birth", F.to_date("birth_datetime"))
    ages = mutate_matching(born, "_date$", lambda c: F.datediff(c, F.col("_birth")), "_age")
    plain = drop_matching(ages, "(_date|_datetime|_time)$").drop("_birth")
    return rename_matching(plain, "_date_age$", "_age")


def scrub_person_info(df: DataFrame, person: DataFrame,
                      person_xwalk: DataFrame | None = None) -> DataFrame:
    """Ages instead of dates and nonce ids instead of person ids."""
    xwalk = gen_xwalk(df, "person_id") if person_xwalk is None else person_xwalk
    return new_id(dates_to_ages(df, person), "person_id", xwalk, replace=True)


def add_site(df: DataFrame, site_tbl: DataFrame, id_col: str = "person_id",
             default: str = "unknown") -> DataFrame:
    """Add ``site`` from a linking table, or a constant when that has none."""
    if "site" in df.columns:
        return df
    if "site" not in site_tbl.columns:
        return df.withColumn("site", F.lit(default))
    return df.join(site_tbl.select(id_col, "site"), id_col, "left")


