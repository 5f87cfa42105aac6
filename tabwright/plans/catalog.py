"""All registered queries of the engine proper, and their SQL oracles."""

from __future__ import annotations

from tabwright.plans import (
    cell_queries,
    chain_queries,
    evidence_queries,
    given_queries,
    given_sources,
    mutation_queries,
    package_queries,
    profile_queries,
    program_queries,
    relational_queries,
    source_queries,
    template_queries,
)
from tabwright.plans.template_queries import flagship

_TEMPLATES, _TEMPLATE_SQL = template_queries.registered()
_FAMILIES = (relational_queries, cell_queries, source_queries, mutation_queries, evidence_queries, chain_queries, program_queries, profile_queries, package_queries)

QUERIES = {"flagship_region_ratio": flagship, **_TEMPLATES}
ORACLES = {"flagship_region_ratio": template_queries.FLAGSHIP_SQL, **_TEMPLATE_SQL}
for _family in _FAMILIES:
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES

#: Checks on literal vectors, for the tests alone: what is registered under their names reads the given tables.
_GIVEN = given_queries.QUERIES | given_sources.QUERIES
LITERAL = {n: QUERIES[n] for n in _GIVEN if n in QUERIES}
LITERAL_ORACLES = {n: ORACLES[n] for n in LITERAL}
QUERIES |= _GIVEN
ORACLES |= given_queries.ORACLES | given_sources.ORACLES
