"""Readable labels for feature keys, as column expressions over a feature dictionary."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import WINDOWS, Window
from cohortloom.functions.text import extract_or_null, sentence_case

# Labels of demographic feature keys.
DEMO_LABELS = {
    "sex_Male": "Sex: Male",
    "sex_Female": "Sex: Female",
    "sex_Other/unknown": "Sex: Other/unknown",
    "eth_Asian/PI": "Race/ethnicity: NH Asian/PI",
    "eth_Black/AA": "Race/ethnicity: NH Black/AA",
    "eth_Hispanic": "Race/ethnicity: Hispanic",
    "eth_White": "Race/ethnicity: NH White",
    "eth_Other/Unknown": "Race/ethnicity: Other/unknown",
    "eth_Multiple": "Race/ethnicity: Multiple",
    "entry_age": "Age",
    "cohort_entry_mar_jul_22": "Cohort entry: Mar-Jul 2022",
    "cohort_entry_mar_jun_21": "Cohort entry: Mar-Jun 2021",
    "cohort_entry_jul_oct_21": "Cohort entry: Jul-Oct 2021",
    "cohort_entry_nov_feb_21": "Cohort entry: Nov 2020-Feb 2021",
    "cohort_entry_nov_feb_22": "Cohort entry: Nov 2021-Feb 2022",
}

# Labels of intensive-care location classes.
LOCATION_LABELS = {
    "Inpatient_non_ICU": "Inpatient non-ICU",
    "Inpatient_ICU": "Inpatient ICU",
    "ED_ICU": "ED ICU",
    "ED_non_ICU": "ED non-ICU",
}


def lookup(col: Column, table: Mapping[str, str], default: Column) -> Column:
    """Value of a small fixed table, else the default."""
    out = None
    for key, value in table.items():
        hit = col == key
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return default if out is None else out.otherwise(default)


def label_demo(key: Column, site_labels: Mapping[str, str] | None = None) -> Column:
    """Label from (kind, value); site labels are study-specific and passed in."""
    sites = {f"site_{site}": label for site, label in (site_labels or {}).items()}
    unnamed_period = F.when(key.startswith("cohort_entry_"), F.concat(
        F.lit("Cohort entry: "), F.regexp_replace(key, "^cohort_entry_", ""))).otherwise(key)
    return lookup(key, {**sites, **DEMO_LABELS}, unnamed_period)


def window_title(window: Column, windows: Sequence[Window] = WINDOWS) -> Column:
    """"0m_to_1m" -> "(0 to 1 m)"."""
    return lookup(window, {w.label: w.title for w in windows}, F.lit(None).cast("string"))


def leading_window(key: Column, windows: Sequence[Window] = WINDOWS) -> Column:
    """The window a ``{window}_{rest}`` key starts with."""
    return _window_where(lambda w: key.startswith(w.label + "_"), windows)


def trailing_window(key: Column, windows: Sequence[Window] = WINDOWS) -> Column:
    """The window a ``{rest}_{window}`` key ends with."""
    return _window_where(lambda w: key.endswith("_" + w.label), windows)


def _window_where(test, windows: Sequence[Window]) -> Column:
    out = None
    for w in windows:
        out = F.when(test(w), w.label) if out is None else out.when(test(w), w.label)
    return out


def before_comma(text: Column) -> Column:
    """Text before the first comma, or all of it."""
    return F.coalesce(extract_or_null(text, "^(.+?),", 1), text)


def _after_window(key: Column, windows: Sequence[Window]) -> Column:
    return key.substr(F.length(leading_window(key, windows)) + 2, F.length(key))


def label_cond(key: Column, windows: Sequence[Window] = WINDOWS) -> Column:
    """``{window}_{name, id}`` -> "name (0 to 1 m)"."""
    return F.concat_ws(" ", before_comma(_after_window(key, windows)),
                       window_title(leading_window(key, windows), windows))


def label_drug(key: Column, windows: Sequence[Window] = WINDOWS) -> Column:
    """As :func:`label_cond`, with the last underscore segment in sentence case."""
    name = before_comma(_after_window(key, windows))
    last = F.coalesce(extract_or_null(name, "_([^_]+)$", 1), name)
    return F.concat_ws(" ", sentence_case(last),
                       window_title(leading_window(key, windows), windows))


def label_util(key: Column, windows: Sequence[Window] = WINDOWS) -> Column:
    """``{location}_{window}`` -> "ED ICU visits (0 to 1 m)"."""
    window = trailing_window(key, windows)
    place = key.substr(F.lit(1), F.length(key) - F.length(window) - 1)
    return F.concat_ws(" ", lookup(place, LOCATION_LABELS, place), F.lit("visits"),
                       window_title(window, windows))


def label_lab_cts(key: Column, windows: Sequence[Window] = WINDOWS) -> Column:
    """Window -> "Lab count (0 to 1 m)"."""
    return F.concat(F.lit("Lab count "), window_title(key, windows))


def feature_dictionary(long: DataFrame, nodes: DataFrame | None = None,
                       site_labels: Mapping[str, str] | None = None,
                       windows: Sequence[Window] = WINDOWS) -> DataFrame:
    """One row per (domain, feature_key) with window and label.

    Condition, lab, procedure and drug keys hold a concept id, so the label is
    built from the node name; the domain says which rule applies.
    """
    keys = long.select("domain", "feature_key").distinct()
    key, domain = F.col("feature_key"), F.col("domain")
    coded = domain.isin("cond", "lab", "proc", "drug")
    keys = keys.withColumn("window", F.when(coded, leading_window(key, windows))
                           .when(domain == "util", trailing_window(key, windows))
                           .when(domain == "lab_cts", key))
    if nodes is not None:
        concept_id = F.when(coded, extract_or_null(key, r"_(\d+)$", 1)).cast("long")
        keys = (keys.withColumn("node_concept_id", concept_id)
                .join(nodes, "node_concept_id", "left"))
    else:
        keys = keys.withColumn("node_concept", F.lit(None).cast("string"))
    named = F.concat_ws("_", "window", F.coalesce("node_concept", F.lit("?")))
    label = (F.when(coded & F.col("node_concept").isNotNull(), label_cond(named, windows))
             .when(domain == "util", label_util(key, windows))
             .when(domain == "lab_cts", label_lab_cts(key, windows))
             .when(domain == "demo", label_demo(key, site_labels))
             .otherwise(key))
    return keys.select("domain", "feature_key", "window", label.alias("label"))


def colname_cleanup(dictionary: DataFrame) -> DataFrame:
    """Keys and labels in domain order, ready for a file."""
    return dictionary.select("domain", "feature_key", "label").orderBy("domain", "feature_key")
