"""Registry of all queries outside the optional subpackage, with their SQL.

Every query reads its whole tables. Doubles are rounded on both sides, since sums depend on the order of
addition. A query without SQL is iterative or needs the enumeration of subformulas; tests compare it with
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peakloom.operators import loading, units
from peakloom.plans import energy_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


for _f in (units.p2_energy, units.p2_found, loading.p6_records, loading.p6_found):
    query(energy_sql.SQL.get(_f.__name__))(_f)

from peakloom.plans import chemistry, evaluation, relational, scoring  # noqa: E402, F401
