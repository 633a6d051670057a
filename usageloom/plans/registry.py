"""The queries by name, and the SQL that each is checked against."""

from __future__ import annotations

from usageloom.plans import fixtures, incremental, scalars, series, usage

QUERIES: dict = usage.QUERIES | series.QUERIES | scalars.QUERIES | fixtures.QUERIES | incremental.QUERIES
ORACLE: dict = usage.ORACLE | series.ORACLE | scalars.ORACLE | fixtures.ORACLE | incremental.ORACLE
