"""The registered queries of the engine and the SQL that says the same, by family."""

from . import catalogue, contract, corpus, fidelity, files, graph, probes, scalars, statistics, upkeep

_FAMILIES = (scalars, files, contract, probes, fidelity, statistics, graph, corpus, catalogue, upkeep)
QUERIES = {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}
ORACLE = {name: sql for family in _FAMILIES for name, sql in family.ORACLE.items()}
