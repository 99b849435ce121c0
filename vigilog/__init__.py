"""Security-log analytics on PySpark: audit and access logs to SQL, address
enrichment, and activity profiles with deviation alerts."""

from vigilog.plans.tables import (
    create_access_saved_table,
    create_access_table,
    create_audit_saved_table,
    create_audit_table,
)
from vigilog.operators.geo import register_geo_functions
from vigilog.operators.profilers import DEFAULT_PROFILERS, Profiler
from vigilog.streaming.analyzer import start_analyzer

__all__ = [
    "DEFAULT_PROFILERS",
    "Profiler",
    "create_access_saved_table",
    "create_access_table",
    "create_audit_saved_table",
    "create_audit_table",
    "register_geo_functions",
    "start_analyzer",
]
