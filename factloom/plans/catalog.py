"""Importing this module registers every query."""

from factloom.plans import report_queries  # noqa: F401
from factloom.plans import scan_queries  # noqa: F401
from factloom.plans import verb_queries  # noqa: F401
from factloom.plans import provenance_queries  # noqa: F401
from factloom.plans import flow_queries  # noqa: F401
