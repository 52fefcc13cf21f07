"""Named queries over a folder of tables, and the SQL that states the same."""

from __future__ import annotations

from drayage.plans import catalog, checks, cleaning, deciding, evidence, learning, resolving, tickets, values

QUERIES = {}
ORACLES = {}
for _part in (catalog, cleaning, checks, learning, resolving, tickets, values, deciding, evidence):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
