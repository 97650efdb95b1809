"""Registered queries over the given tables, each beside its SQL."""

from barloom.catalog import auditing, evaluation, features, flows, fusing, indicators, inputs, modelling, outliers, recursive, scans, selection, streams

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (indicators, recursive, features, fusing, auditing, inputs, selection, evaluation, modelling, outliers, scans, streams, flows):
    clash = QUERIES.keys() & _part.QUERIES.keys()
    if clash:
        raise ValueError(f"query registered twice: {sorted(clash)}")
    QUERIES.update(_part.QUERIES)
    ORACLE.update(_part.ORACLE)
