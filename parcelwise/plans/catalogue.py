"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from . import assembly, ensembles, evaluation, grids, joins, models, rasters, samples, shapes, values

FAMILIES = (grids, joins, values, ensembles, samples, evaluation, models, assembly, shapes, rasters)
QUERIES = {name: build for family in FAMILIES for name, (build, _) in family.ALL.items()}
ORACLE_SQL = {name: sql for family in FAMILIES for name, (_, sql) in family.ALL.items() if sql}
