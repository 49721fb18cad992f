"""Frozen study settings.  Operators take these values; none hides a literal."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from datetime import date
from typing import Callable


@dataclass(frozen=True)
class Domain:
    """What differs between the four event vocabularies."""

    name: str
    table: str
    concept_col: str
    vocabularies: tuple[str, ...]
    domain_id: str
    event_id_col: str | None = None  # only domains with it get the label anti-join
    members: tuple["Domain", ...] = ()  # domains stacked under a ``domain`` column


# Vocabulary and domain names of the common data model.
DOMAINS: dict[str, Domain] = {
    "cond": Domain("cond", "condition_occurrence", "condition_concept_id",
                   ("SNOMED",), "Condition", "condition_occurrence_id"),
    "lab": Domain("lab", "measurement_labs", "measurement_concept_id",
                  ("LOINC",), "Measurement"),
    "proc": Domain("proc", "procedure_occurrence", "procedure_concept_id",
                   ("ICD10PCS", "HCPCS", "CPT4"), "Procedure"),
    "drug": Domain("drug", "drug_exposure", "drug_concept_id",
                   ("RxNorm",), "Drug"),
}


# All four stacked: one pass over (domain, person, visit, concept, event id) rows.
STACKED = Domain("stacked", "events", "concept_id", (), "", "event_id",
                 tuple(DOMAINS.values()))


@dataclass(frozen=True)
class Window:
    """Half-open day range [lo, hi) around the index date; ``lo=None`` is unbounded."""

    label: str
    lo: int | None
    hi: int
    title: str


# Window labels and day edges.
WINDOWS: tuple[Window, ...] = (
    Window("-1m_to_0m", None, 0, "(-1 to 0 m)"),
    Window("0m_to_1m", 0, 30, "(0 to 1 m)"),
    Window("1m_to_2m", 30, 60, "(1 to 2 m)"),
    Window("2m_to_3m", 60, 90, "(2 to 3 m)"),
    Window("3m_to_6m", 90, 180, "(3 to 6 m)"),
)

# Visit location classes.
UTIL_LOCATIONS: tuple[str, ...] = (
    "Inpatient_ICU",
    "Inpatient_non_ICU",
    "ED_ICU",
    "ED_non_ICU",
    "Outpatient Office",
    "Outpatient: Test Only",
    "Other/Unknown",
)

_OPS: dict[str, Callable] = {">": operator.gt, ">=": operator.ge,
                             "<": operator.lt, "<=": operator.le}


def compare(op: str, left, right):
    """Apply a named comparison, so that strictness is a setting."""
    return _OPS[op](left, right)


@dataclass(frozen=True)
class CutThreshold:
    """Which scanned nodes count as significant."""

    level: int
    observations: int
    p_value: float = 0.01
    level_op: str = ">="
    observations_op: str = ">="
    p_op: str = "<"


# Thresholds per domain; drugs use looser ones on the full cohort.
CUT_THRESHOLDS: dict[str, CutThreshold] = {
    "cond": CutThreshold(3, 1600, level_op=">", observations_op=">"),
    "lab": CutThreshold(3, 10000, observations_op=">"),
    "proc": CutThreshold(3, 100, observations_op=">"),
    "drug": CutThreshold(2, 500, observations_op=">"),
    "drug_all": CutThreshold(2, 200, p_value=0.05, observations_op=">"),
}


@dataclass(frozen=True)
class PhenotypeConfig:
    """All study parameters with their default values."""

    # Observation, value, service and visit concept ids.
    pcr_concept: int = 2000001530
    antigen_concept: int = 2000001529
    serology_concept: int = 2000001528
    positive_values: tuple[int, ...] = (9191, 2000001526)
    diagnosis_concept: int = 2000001527
    diagnosis_a_value: int = 2000001520
    diagnosis_b_value: int = 703578
    icu_services: tuple[int, ...] = (2000000079, 2000000080, 2000000078)
    inpatient_visits: tuple[int, ...] = (9201, 2000000088, 2000000048)
    ed_visits: tuple[int, ...] = (9203,)
    office_visits: tuple[int, ...] = (9202, 581399)
    test_only_visits: tuple[int, ...] = (2000000469, 44814711)
    male: int = 8507
    female: int = 8532
    hispanic: int = 38003563
    black: int = 8516
    asian: tuple[int, ...] = (8515, 8557)
    white: int = 8527
    multiple_race: int = 44814659
    leak_root: int = 444201
    leak_text_pattern: str = "Post-COVID"
    excluded_clusters: tuple[str, ...] = ("pasc", "multisystem inflammatory syndrome")
    # Roots added to the condition tree export.
    condition_roots: tuple[tuple[int, str], ...] = (
        (441840, "Clinical finding"),
        (4194404, "Disorder confirmed"),
    )

    # Study period and follow-up.
    min_date: date = date(2020, 11, 1)
    max_date: date = date(2022, 9, 1)
    min_window: int = -90
    max_window: int = -28
    n_visits: int = 2
    days_delta: int = -28
    follow_months: int = 6
    days_min: int = 27
    days_max: int = 180
    max_age: int = 21
    windows: tuple[Window, ...] = WINDOWS
    # Fixed values: (label, first month, last month), both ends included.
    entry_periods: tuple[tuple[str, str, str], ...] = (
        ("nov_feb_21", "2020-01", "2021-02"),
        ("mar_jun_21", "2021-03", "2021-06"),
        ("jul_oct_21", "2021-07", "2021-10"),
        ("nov_feb_22", "2021-11", "2022-02"),
        ("mar_jul_22", "2022-03", "2022-07"),
    )
    folds: int = 5
    seed: int = 11015
    impute_seed: int = 1234

    # Model.
    trees: int = 150
    learning_rate: float = 0.1
    column_sample: float = 0.7
    tree_depth: int = 6
    thresholds: tuple[float, ...] = (0.5, 0.2)

    site: str = "unknown"
    cut_thresholds: dict[str, CutThreshold] = field(
        default_factory=lambda: dict(CUT_THRESHOLDS))

    @property
    def test_concepts(self) -> tuple[int, ...]:
        return (self.pcr_concept, self.antigen_concept, self.serology_concept)

    @property
    def diagnosis_values(self) -> tuple[int, ...]:
        return (self.diagnosis_a_value, self.diagnosis_b_value)
