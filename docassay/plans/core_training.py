"""Queries and comparison SQL of the general data operators: units, nested records, timestamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import nested, timestamps, units
from ..sources.tables import table
from . import independent


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: units.equal_quantities(s, table(s, d, "cells"), table(s, d, "rules"), table(s, d, "unit_targets")),
        "p1_values": lambda s, d: units.cell_values(s, table(s, d, "cells"), table(s, d, "unit_targets")),
        "p4_found": lambda s, d: nested.boxes(table(s, d, "issues"), "issue_id", "evidence"),
        "p4_tables": lambda s, d: nested.flat_tables(table(s, d, "issues"), "issue_id", "evidence"),
        "p7_status": lambda s, d: timestamps.resolved(s, table(s, d, "doc_metadata"), table(s, d, "sites")),
        "p7_found": lambda s, d: timestamps.unambiguous(s, table(s, d, "doc_metadata"), table(s, d, "sites")),
    }


def oracle_sql() -> dict[str, str]:
    own = independent.oracle_sql()
    return {name: own[name] for name in queries() if name in own}
