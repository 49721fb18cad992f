"""Observational cohort analytics as Spark DataFrame transformations.

Sub-packages
------------
``sources``    table catalog, typed readers and writers, input schemas
``functions``  column expressions and distributed building blocks
``operators``  one public function per cohort / event / hierarchy / model operator
``plans``      the end-to-end jobs composed of operators
``suite``      the registered queries and their SQL counterparts
"""

from cohortloom.config import DOMAINS, Domain, PhenotypeConfig

__all__ = ["DOMAINS", "Domain", "PhenotypeConfig"]
