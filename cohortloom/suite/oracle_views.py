"""SQL views over the driver tables that mirror the star mapping and the cohort funnel."""

from __future__ import annotations

import re

from cohortloom.config import DOMAINS, WINDOWS
from cohortloom.sources.star_mapping import (DOMAIN_NUMBER, GROUPS, ID_RANGE, PROMO_NODE, ROOT,
                                             SOURCE_10_NUMBER, SOURCE_NUMBER, STAR_CONFIG)

MAX_DATE = f"DATE '{STAR_CONFIG.max_date}'"
MIN_DATE = f"DATE '{STAR_CONFIG.min_date}'"


def h32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def months(expr: str, n: int) -> str:
    sign = "+" if n >= 0 else "-"
    return f"CAST({expr} {sign} INTERVAL {abs(n)} MONTH AS DATE)"


def brand_id(domain: str) -> str:
    return f"({DOMAIN_NUMBER[domain] * ID_RANGE + GROUPS} + {h32(_BRAND)})"


def type_id(domain: str) -> str:
    return f"({DOMAIN_NUMBER[domain] * ID_RANGE + GROUPS} + {h32(_TYPE)})"


def leaf_id(domain: str) -> str:
    return f"(p_partkey + {DOMAIN_NUMBER[domain] * ID_RANGE + 1})"


_BRAND = "'b|' || p_type || '|' || p_brand"
_TYPE = "'t|' || p_type"
_LINE_FILTER = {"cond": "l_returnflag = 'R'", "drug": "l_returnflag = 'A'",
                "lab": "l_returnflag = 'N' AND l_linestatus = 'O'",
                "proc": "l_returnflag = 'N' AND l_linestatus = 'F'"}


def _concepts(domain: str) -> str:
    d = DOMAINS[domain]
    n = DOMAIN_NUMBER[domain]
    top = f"'{d.vocabularies[-1]}'"
    if len(d.vocabularies) > 1:
        cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(d.vocabularies))
        leaf = f"CASE p_partkey % {len(d.vocabularies)} {cases} END"
    else:
        leaf = top
    brand_class = "Ingredient" if domain == "drug" else "Group"
    tail = f"'{d.domain_id}' AS domain_id"
    return f"""
    SELECT {leaf_id(domain)} AS concept_id, p_name AS concept_name,
           'P' || p_partkey AS concept_code, {leaf} AS vocabulary_id, {tail},
           'Leaf' AS concept_class_id, NULL::VARCHAR AS invalid_reason FROM part
    UNION ALL
    SELECT DISTINCT {brand_id(domain)}, p_type || '_' || p_brand, {_BRAND}, {top}, {tail},
           '{brand_class}', NULL::VARCHAR FROM part
    UNION ALL
    SELECT DISTINCT {type_id(domain)}, p_type, {_TYPE}, {top}, {tail}, 'Group', NULL::VARCHAR
    FROM part
    UNION ALL
    SELECT {n * ID_RANGE + ROOT}, 'All {d.domain_id}', 'root', {top}, {tail}, 'Root',
           NULL::VARCHAR"""


def _closure(domain: str) -> str:
    leaf, brand, kind = leaf_id(domain), brand_id(domain), type_id(domain)
    root = f"{DOMAIN_NUMBER[domain] * ID_RANGE + ROOT}"
    rows = [f"SELECT {a} AS ancestor_concept_id, {d} AS descendant_concept_id, "
            f"{n} AS min_levels_of_separation FROM {src}"
            for a, d, n, src in (
                (leaf, leaf, 0, "part"), (brand, leaf, 1, "part"), (kind, leaf, 2, "part"),
                (root, leaf, 3, "part"), (brand, brand, 0, "brands"), (kind, brand, 1, "brands"),
                (root, brand, 2, "brands"), (kind, kind, 0, "kinds"), (root, kind, 1, "kinds"))]
    rows.append(f"SELECT {root}, {root}, 0")
    return "\n    UNION ALL ".join(rows)


def _window_case(event: str, index: str = "index_date") -> str:
    arms = []
    for w in WINDOWS:
        low = "" if w.lo is None else f"{event} - {index} >= {w.lo} AND "
        arms.append(f"WHEN {low}{event} - {index} < {w.hi} THEN '{w.label}'")
    return "CASE " + " ".join(arms) + " END"


window_case = _window_case
_PERIODS = " ".join(f"WHEN strftime(index_date, '%Y-%m') BETWEEN '{a}' AND '{b}' THEN '{n}'"
                    for n, a, b in STAR_CONFIG.entry_periods)

_SIMPLE = {
    "visits": """
    SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id,
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 9203 WHEN '2' THEN 9201
             WHEN '3' THEN 9202 WHEN '4' THEN 44814711 ELSE 0 END::BIGINT AS visit_concept_id,
           o_orderdate::DATE AS visit_start_date
    FROM orders""",
    "adt": """
    SELECT o_orderkey AS visit_occurrence_id, 2000000079::BIGINT AS service_concept_id
    FROM orders WHERE o_orderstatus = 'F'""",
    "lines": """
    SELECT l.*, o_custkey AS person_id, o_orderdate::DATE AS event_date,
           l_orderkey AS visit_occurrence_id,
           md5(concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR,
             l_suppkey::VARCHAR, l_linenumber::VARCHAR, l_quantity::INT::VARCHAR,
             floor(l_extendedprice * 100 + 0.5)::BIGINT::VARCHAR,
             floor(l_discount * 100 + 0.5)::BIGINT::VARCHAR, floor(l_tax * 100 + 0.5)::BIGINT::VARCHAR,
             l_returnflag, l_linestatus, l_shipdate::DATE::VARCHAR)) AS event_id
    FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""",
    "conditions": f"""
    SELECT event_id AS condition_occurrence_id, person_id, visit_occurrence_id,
           {leaf_id('cond')} AS condition_concept_id,
           {leaf_id('cond')} AS condition_source_concept_id, p_name AS condition_source_value
    FROM lines JOIN part ON l_partkey = p_partkey WHERE {_LINE_FILTER['cond']}""",
    **{f"ev_{d}": f"""
    SELECT event_id, person_id, visit_occurrence_id, event_date,
           l_partkey + {DOMAIN_NUMBER[d] * ID_RANGE + 1} AS concept_id
    FROM lines WHERE {_LINE_FILTER[d]}""" for d in DOMAINS},
    "obs": f"""
    SELECT person_id, visit_occurrence_id, event_date AS observation_date,
           CASE l_quantity WHEN 1 THEN 2000001530 WHEN 2 THEN 2000001529 WHEN 3 THEN 2000001528
             ELSE 2000001527 END::BIGINT AS observation_concept_id,
           CASE WHEN l_quantity < 50 AND l_linestatus = 'F' THEN 2000001526
             WHEN l_quantity < 50 THEN 9191
             WHEN p_type = 'PROMO' THEN 2000001520 WHEN p_type = 'ECONOMY' THEN 703578
           END::BIGINT AS value_as_concept_id, event_id AS observation_source_concept_id
    FROM lines JOIN part ON l_partkey = p_partkey
    WHERE l_quantity IN (1, 2, 3, 50)
      AND (l_quantity < 50 OR p_type IN ('PROMO', 'ECONOMY'))""",
    "person": """
    SELECT c_custkey AS person_id,
           (DATE '1976-01-01' + (c_custkey * 37 % 6000)::INT)::DATE AS birth_date,
           r_name AS site,
           CASE c_custkey % 3 WHEN 0 THEN 8507 WHEN 1 THEN 8532 ELSE 0 END::BIGINT
             AS gender_concept_id,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 8527 WHEN 'BUILDING' THEN 8516
             WHEN 'FURNITURE' THEN 8515 WHEN 'HOUSEHOLD' THEN 44814659 ELSE 0 END::BIGINT
             AS race_concept_id,
           CASE WHEN c_nationkey % 7 = 0 THEN 38003563 ELSE 0 END::BIGINT
             AS ethnicity_concept_id
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""",
    "brands": "SELECT DISTINCT p_type, p_brand FROM part",
    "kinds": "SELECT DISTINCT p_type FROM part",
    "concept": "\n    UNION ALL".join(_concepts(d) for d in DOMAINS) + f"""
    UNION ALL
    SELECT p_partkey + {SOURCE_NUMBER * ID_RANGE + 1}, 'src ' || p_name, 'S' || p_partkey,
           'ICD10CM', 'Condition', 'Code', CASE WHEN p_size % 10 = 0 THEN 'D' END FROM part
    UNION ALL
    SELECT p_partkey + {SOURCE_10_NUMBER * ID_RANGE + 1}, 'src ' || p_name, 'S' || p_partkey,
           'ICD10', 'Condition', 'Code', CASE WHEN p_size % 10 = 0 THEN 'D' END FROM part
    WHERE p_size % 5 = 1""",
    "closure": "\n    UNION ALL ".join(_closure(d) for d in DOMAINS),
    "relationship": f"""
    SELECT p_partkey + {SOURCE_NUMBER * ID_RANGE + 1} AS concept_id_1,
           {leaf_id('cond')} AS concept_id_2, 'Maps to' AS relationship_id,
           CASE WHEN p_size % 10 = 2 THEN 'D' END AS invalid_reason FROM part
    UNION ALL
    SELECT p_partkey + {SOURCE_NUMBER * ID_RANGE + 1}, {brand_id('cond')}, 'Maps to', NULL
    FROM part WHERE p_size % 10 = 3
    UNION ALL
    SELECT {leaf_id('cond')}, p_partkey + {SOURCE_NUMBER * ID_RANGE + 1}, 'Mapped from',
           CASE WHEN p_size % 10 = 2 THEN 'D' END FROM part""",
    "raw_codes": """
    SELECT 'S' || p_partkey AS code,
           p_name || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' (SNOMED) '
             ELSE ' (ICD10CM)' END AS description FROM part""",
    "rules": f"""
    SELECT {leaf_id('cond')} AS condition_concept_id,
           {leaf_id('cond')} AS condition_source_concept_id, p_name AS condition_source_value,
           CASE WHEN p_size >= 45 THEN 'pasc' WHEN p_size >= 40 THEN 'drop' ELSE 'ignore' END
             AS action
    FROM part WHERE p_type = 'LARGE' AND p_size >= 35""",
    "clusters": f"SELECT {leaf_id('cond')} AS concept_id, p_brand AS cluster FROM part",
    "codeset": f"""
    SELECT DISTINCT {type_id('cond')} AS concept_id, p_type AS concept_name,
           {_TYPE} AS concept_code, 'SNOMED' AS vocabulary_id FROM part""",
    "predictions": f"""
    SELECT *, 1 - p1 - p2 AS p0 FROM (
      SELECT o_orderkey AS person_id, (o_orderkey % 5 + 1)::INT AS fold,
             (o_orderkey % 3)::INT AS y3,
             least(49, {h32("o_orderkey || 'a'")} % 40
               + CASE WHEN o_orderkey % 3 = 1 THEN 12 ELSE 0 END) / 100.0 AS p1,
             least(49, {h32("o_orderkey || 'b'")} % 40
               + CASE WHEN o_orderkey % 3 = 2 THEN 12 ELSE 0 END) / 100.0 AS p2
      FROM orders)""",
    # cohort funnel ------------------------------------------------------------
    "labelled": f"""
    SELECT * FROM (
      SELECT person_id, observation_date, visit_occurrence_id,
             CASE WHEN observation_concept_id = 2000001527 AND value_as_concept_id = 2000001520
                    THEN 'pasc'
                  WHEN observation_concept_id = 2000001527 AND value_as_concept_id = 703578
                    THEN 'misc'
                  WHEN observation_concept_id = 2000001530
                    AND value_as_concept_id IN (9191, 2000001526) THEN 'pcr'
                  WHEN observation_concept_id = 2000001529
                    AND value_as_concept_id IN (9191, 2000001526) THEN 'antigen'
                  WHEN observation_concept_id = 2000001528
                    AND value_as_concept_id IN (9191, 2000001526) THEN 'serology'
             END AS label_type
      FROM obs WHERE observation_date <= {MAX_DATE}) WHERE label_type IS NOT NULL""",
    "case_persons": """
    SELECT person_id, max((label_type = 'misc')::INT) AS has_b FROM labelled
    WHERE label_type IN ('pasc', 'misc') GROUP BY person_id""",
    "base_cohort": """
    SELECT person_id, pasc_flag, pasc_not_misc_flag, observation_date AS index_date,
           label_type AS observation_type, visit_occurrence_id AS index_visit_occurrence_id
    FROM (
      SELECT l.*, (c.person_id IS NOT NULL)::INT AS pasc_flag,
             (c.person_id IS NOT NULL AND c.has_b = 0)::INT AS pasc_not_misc_flag,
             row_number() OVER (PARTITION BY l.person_id
               ORDER BY observation_date, label_type, visit_occurrence_id) AS rn
      FROM labelled l LEFT JOIN case_persons c ON l.person_id = c.person_id
      WHERE c.person_id IS NULL OR l.label_type IN ('pasc', 'misc'))
    WHERE rn = 1""",
    "rule_hits": f"""
    SELECT DISTINCT b.person_id, r.action, v.visit_start_date
    FROM base_cohort b
    JOIN conditions e ON e.person_id = b.person_id
    JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
    JOIN rules r ON r.condition_concept_id = e.condition_concept_id
      AND r.condition_source_concept_id = e.condition_source_concept_id
      AND r.condition_source_value = e.condition_source_value
    WHERE b.pasc_flag = 0 AND v.visit_start_date < {MAX_DATE}
      AND v.visit_start_date > b.index_date""",
    "adjusted": """
    SELECT person_id, pasc_flag, pasc_not_misc_flag, index_date,
           CASE WHEN pasc_flag = 1 AND pasc_not_misc_flag = 1 THEN 'non_misc_pasc'
                WHEN pasc_flag = 1 THEN 'misc' ELSE observation_type END AS observation_type,
           index_visit_occurrence_id
    FROM (
      SELECT b.person_id, CASE WHEN s.d IS NULL THEN pasc_flag ELSE 1 END AS pasc_flag,
             CASE WHEN s.d IS NULL THEN pasc_not_misc_flag ELSE 1 END AS pasc_not_misc_flag,
             coalesce(s.d, index_date) AS index_date, observation_type,
             index_visit_occurrence_id
      FROM base_cohort b
      LEFT JOIN (SELECT person_id, min(visit_start_date) AS d FROM rule_hits
                 WHERE action = 'pasc' GROUP BY person_id) s ON s.person_id = b.person_id
      WHERE b.person_id NOT IN (SELECT person_id FROM rule_hits WHERE action = 'drop'))""",
    "followed": """
    SELECT a.* FROM adjusted a WHERE (
      SELECT count(DISTINCT v.visit_start_date) FROM visits v
      WHERE v.person_id = a.person_id AND v.visit_start_date > a.index_date) >= 2""",
    "imputed": f"""
    SELECT * REPLACE (CASE WHEN pasc_flag = 1 THEN
      (index_date + (-90 + {h32("person_id || '|1234'")} % 63)::INT)::DATE
      ELSE index_date END AS index_date) FROM followed""",
    "demo": """
    SELECT * FROM (
      SELECT i.*, birth_date, site,
             CASE gender_concept_id WHEN 8507 THEN 'Male' WHEN 8532 THEN 'Female'
               ELSE 'Other/unknown' END AS sex_cat,
             CASE WHEN ethnicity_concept_id = 38003563 THEN 'Hispanic'
               WHEN race_concept_id = 8516 THEN 'Black/AA'
               WHEN race_concept_id IN (8515, 8557) THEN 'Asian/PI'
               WHEN race_concept_id = 8527 THEN 'White'
               WHEN race_concept_id = 44814659 THEN 'Multiple'
               ELSE 'Other/Unknown' END AS eth_cat,
             floor((index_date - birth_date) / 365.25)::INT AS entry_age
      FROM imputed i JOIN person p ON p.person_id = i.person_id) WHERE entry_age < 21""",
    "dated": f"""
    SELECT * FROM demo WHERE index_date >= {MIN_DATE} AND index_date < {months(MAX_DATE, -1)}""",
    "study": f"""
    SELECT * FROM (
      SELECT *, month(index_date)::INT AS index_month, year(index_date)::INT AS index_year,
             CASE {_PERIODS} END AS cohort_entry_period FROM dated)
    WHERE cohort_entry_period IS NOT NULL""",
    "folded": """
    SELECT *, ((row_number() OVER (PARTITION BY pasc_flag
      ORDER BY md5(person_id || '|11015'), person_id) - 1) % 5 + 1)::INT AS fold FROM study""",
    # events ---------------------------------------------------------------------
    "icu": """
    SELECT DISTINCT visit_occurrence_id FROM adt
    WHERE service_concept_id IN (2000000079, 2000000080, 2000000078)""",
    "util": """
    SELECT s.*, v.visit_start_date AS util_start_date,
           CASE WHEN visit_concept_id IN (9201, 2000000088, 2000000048)
                  AND i.visit_occurrence_id IS NOT NULL THEN 'Inpatient_ICU'
                WHEN visit_concept_id IN (9201, 2000000088, 2000000048) THEN 'Inpatient_non_ICU'
                WHEN visit_concept_id = 9203 AND i.visit_occurrence_id IS NOT NULL THEN 'ED_ICU'
                WHEN visit_concept_id = 9203 THEN 'ED_non_ICU'
                WHEN visit_concept_id IN (9202, 581399) THEN 'Outpatient Office'
                WHEN visit_concept_id IN (2000000469, 44814711) THEN 'Outpatient: Test Only'
                ELSE 'Other/Unknown' END AS util_loc
    FROM folded s JOIN visits v ON v.person_id = s.person_id
    LEFT JOIN icu i ON i.visit_occurrence_id = v.visit_occurrence_id
    WHERE v.visit_start_date >= s.index_date - 28""",
    "lab_cts": """
    SELECT s.*, e.concept_id AS measurement_concept_id, v.visit_start_date AS lab_start_date
    FROM folded s JOIN ev_lab e ON e.person_id = s.person_id
    JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
    WHERE v.visit_start_date >= s.index_date - 28""",
    "diagnosis_sources": """
    SELECT observation_source_concept_id AS source FROM obs
    WHERE observation_concept_id = 2000001527
      AND value_as_concept_id IN (2000001520, 703578)""",
}


def _tree(domain: str) -> str:
    d = DOMAINS[domain]
    names = ", ".join(f"'{v}'" for v in d.vocabularies)
    return f"""
    SELECT a.concept_id AS ancestor_concept_id, a.concept_name AS ancestor_concept_name,
           c.concept_id AS descendant_concept_id, c.concept_name AS descendant_concept_name
    FROM (SELECT DISTINCT concept_id, concept_name FROM concept
          WHERE vocabulary_id IN ({names}) AND domain_id = '{d.domain_id}') a
    JOIN closure k ON k.ancestor_concept_id = a.concept_id
    JOIN concept c ON c.concept_id = k.descendant_concept_id
    WHERE k.min_levels_of_separation = 1"""


def _nodes(tree: str) -> str:
    return f"""
    SELECT ancestor_concept_name || ', ' || ancestor_concept_id AS node_concept,
           ancestor_concept_id AS node_concept_id FROM {tree}
    UNION
    SELECT descendant_concept_name || ', ' || descendant_concept_id, descendant_concept_id
    FROM {tree}"""


def _scan(domain: str, by: str = "") -> str:
    # by is "" or "fold, ": the train set of every fold, or the whole cohort
    members = ("(SELECT person_id, pasc_flag, index_date, t.n AS fold FROM folded "
               "JOIN (SELECT unnest(range(1, 6)) AS n) t ON t.n <> folded.fold)"
               if by else "folded")
    return f"""
    SELECT {by}(node % 1000003)::INT AS cut_no, node AS node_identifier, level AS tree_level,
           round(cases / persons / 0.25, 6) AS relative_risk,
           round(cases / persons, 6) AS log_likelihood_ratio, persons AS observations,
           persons * 0.25::DOUBLE AS expected,
           CASE WHEN cases / persons > 0.4 THEN 0.001::DOUBLE
                WHEN cases / persons > 0.1 THEN 0.5::DOUBLE END AS p_value
    FROM (
      SELECT {by}node, level, count(*) AS persons, sum(pasc_flag)::BIGINT AS cases FROM (
        SELECT DISTINCT {by}m.person_id, pasc_flag, g.node, g.level
        FROM {members} m JOIN ev_{domain} e ON e.person_id = m.person_id
        JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
        JOIN (SELECT {leaf_id(domain)} AS leaf, {brand_id(domain)} AS node, 2 AS level FROM part
              UNION ALL SELECT {leaf_id(domain)}, {type_id(domain)}, 1 FROM part) g
          ON g.leaf = e.concept_id
        WHERE m.index_date < {months(MAX_DATE, -6)}
          AND v.visit_start_date >= m.index_date - 28
          AND v.visit_start_date < CAST(m.index_date + INTERVAL 6 MONTH AS DATE))
      GROUP BY {by}node, level)"""


def _features(domain: str, cuts: str, by: str = "") -> str:
    d = DOMAINS[domain]
    names = ", ".join(f"'{v}'" for v in d.vocabularies)
    return f"""
    SELECT DISTINCT {by}k.ancestor_concept_id, na.node_concept AS ancestor_concept,
           k.descendant_concept_id, nd.node_concept AS descendant_concept
    FROM (SELECT DISTINCT {by}node_identifier FROM {cuts}) c
    JOIN closure k ON k.ancestor_concept_id = c.node_identifier
    JOIN (SELECT DISTINCT concept_id FROM concept WHERE vocabulary_id IN ({names})
          AND domain_id = '{d.domain_id}') a ON a.concept_id = k.ancestor_concept_id
    JOIN (SELECT DISTINCT concept_id FROM concept) x ON x.concept_id = k.descendant_concept_id
    JOIN nodes_{domain} nd ON nd.node_concept_id = k.descendant_concept_id
    LEFT JOIN nodes_{domain} na ON na.node_concept_id = k.ancestor_concept_id
    WHERE k.ancestor_concept_id <> 0 AND k.descendant_concept_id <> 0"""


def _feature_events(domain: str, features: str) -> str:
    return f"""
    SELECT s.*, e.event_id, f.ancestor_concept_id, f.ancestor_concept, f.descendant_concept_id,
           f.descendant_concept, v.visit_start_date
    FROM folded s JOIN ev_{domain} e ON e.person_id = s.person_id
    JOIN {features} f ON f.descendant_concept_id = e.concept_id
    JOIN visits v ON v.visit_occurrence_id = e.visit_occurrence_id
    WHERE v.visit_start_date >= s.index_date - 28"""


def _guarded(domain: str, events: str) -> str:
    anti = (" AND event_id NOT IN (SELECT source FROM diagnosis_sources)"
            if domain == "cond" else "")
    return f"SELECT * FROM {events} WHERE ancestor_concept_id <> {PROMO_NODE}{anti}"


def _flags(events: str) -> str:
    return f"""
    SELECT DISTINCT person_id, index_date, observation_type, pasc_flag,
           w || '_' || ancestor_concept_id AS feature_key, 1::BIGINT AS value
    FROM (SELECT *, {_window_case('visit_start_date')} AS w FROM {events})
    WHERE w IS NOT NULL"""


def _views() -> dict[str, str]:
    views = dict(_SIMPLE)
    for d in DOMAINS:
        views[f"tree_full_{d}"] = _tree(d)
        if d == "cond":
            below = (f"(SELECT descendant_concept_id FROM closure "
                     f"WHERE ancestor_concept_id = {PROMO_NODE})")
            views["tree_cond"] = (f"SELECT * FROM tree_full_cond WHERE ancestor_concept_id "
                                  f"NOT IN {below} AND descendant_concept_id NOT IN {below}")
        else:
            views[f"tree_{d}"] = f"SELECT * FROM tree_full_{d}"
        views[f"nodes_{d}"] = _nodes(f"tree_{d}")
        views[f"scan_{d}"] = _scan(d)
        views[f"scan_fold_{d}"] = _scan(d, "fold, ")
        keep = "p_value IS NOT NULL AND tree_level > 1 AND observations >= 2 AND p_value < 0.01"
        views[f"cuts_{d}"] = f"SELECT * FROM scan_{d} WHERE {keep}"
        views[f"cuts_fold_{d}"] = f"SELECT * FROM scan_fold_{d} WHERE {keep}"
        views[f"type_cuts_{d}"] = (f"SELECT * FROM scan_{d} "
                                   f"WHERE tree_level = 1 AND p_value IS NOT NULL")
        views[f"features_{d}"] = _features(d, f"cuts_{d}")
        views[f"features_fold_{d}"] = _features(d, f"cuts_fold_{d}", "fold, ")
        views[f"type_features_{d}"] = _features(d, f"type_cuts_{d}")
        views[f"events_{d}"] = _feature_events(d, f"features_{d}")
        views[f"type_events_{d}"] = _feature_events(d, f"type_features_{d}")
        views[f"safe_{d}"] = _guarded(d, f"events_{d}")
        views[f"type_safe_{d}"] = _guarded(d, f"type_events_{d}")
        views[f"long_{d}"] = _flags(f"safe_{d}")
        views[f"type_long_{d}"] = _flags(f"type_safe_{d}")
    views["long_util"] = f"""
    SELECT person_id, index_date, observation_type, pasc_flag,
           util_loc || '_' || w AS feature_key, count(DISTINCT util_start_date) AS value
    FROM (SELECT *, {_window_case('util_start_date')} AS w FROM util) WHERE w IS NOT NULL
    GROUP BY ALL"""
    views["long_lab_cts"] = f"""
    SELECT person_id, index_date, observation_type, pasc_flag, w AS feature_key,
           sum(days)::BIGINT AS value
    FROM (SELECT person_id, index_date, observation_type, pasc_flag, w, measurement_concept_id,
                 count(DISTINCT lab_start_date) AS days
          FROM (SELECT *, {_window_case('lab_start_date')} AS w FROM lab_cts)
          WHERE w IS NOT NULL GROUP BY ALL) GROUP BY ALL"""
    views["long_demo"] = """
    SELECT person_id, 'site_' || site AS feature_key, 1.0::DOUBLE AS value FROM folded
    UNION ALL SELECT person_id, 'sex_' || sex_cat, 1.0 FROM folded
    UNION ALL SELECT person_id, 'eth_' || eth_cat, 1.0 FROM folded
    UNION ALL SELECT person_id, 'cohort_entry_' || cohort_entry_period, 1.0 FROM folded
    UNION ALL SELECT person_id, 'entry_age', entry_age::DOUBLE FROM folded"""
    views["long_all"] = "\n    UNION ALL ".join(
        [f"SELECT person_id, '{d}' AS domain, feature_key, value::DOUBLE AS value FROM long_{d}"
         for d in ("demo", "cond", "drug", "util", "lab", "proc", "lab_cts")])
    views["ovr"] = """
    SELECT fold, 'pasc_any' AS task, (y3 IN (1, 2))::INT AS y, p1 + p2 AS p FROM predictions
    UNION ALL SELECT fold, 'non_misc', (y3 = 2)::INT, p2 FROM predictions
    UNION ALL SELECT fold, 'misc', (y3 = 1)::INT, p1 FROM predictions"""
    return views


VIEWS = _views()


def _needed(sql: str) -> list[str]:
    """Views the statement uses, directly or through others, in definition order."""
    seen: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\b[a-z_]\w*\b", todo.pop()))
        for name in words & VIEWS.keys() - seen:
            seen.add(name)
            todo.append(VIEWS[name])
    return [name for name in VIEWS if name in seen]


_SHARED = ("lines", "folded", "closure", "visits", "long_all")


def with_views(sql: str) -> str:
    """The statement with the views it uses in front."""
    names = _needed(sql)
    if not names:
        return sql
    # Views that several others read are computed once.
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in _SHARED else ''}({VIEWS[n]})"
                      for n in names)
    return f"WITH {ctes}\n{sql}"
