"""All registered queries; importing a module here registers its queries."""

from . import association_q, consensus_q, functions_q, observation_q, quality_q, scenarios_q, scoring_q, similarity_q, sources_q  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
