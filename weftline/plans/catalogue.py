"""All queries of the library and the SQL that they equal."""

from . import queries_more, queries_pages, queries_scores, queries_tables  # noqa: F401  (they register themselves)
from .registry import CATALOGUE

FLAGSHIP = "bow_micro_f1"
QUERIES = CATALOGUE.queries
ORACLE_SQL = CATALOGUE.sql
