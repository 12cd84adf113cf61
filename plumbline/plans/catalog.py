"""All core queries with their SQL, family by family."""

from __future__ import annotations

from plumbline.plans import combining, expressions, geometry, io, modelling, ordering, problems, statistics

FLAGSHIP = "ratio_study"
FAMILIES = [problems, expressions.family, combining.family, ordering.family, statistics.family, modelling.family, geometry.family, io.family]
QUERIES = {name: f for family in FAMILIES for name, f in family.QUERIES.items()}
SQL = {name: s for family in FAMILIES for name, s in family.SQL.items()}
