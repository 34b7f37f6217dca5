"""All registered queries (importing the modules fills the registry)."""

from exposa.plans import q_agg, q_cells, q_clean, q_closed, q_core, q_fits, q_geo, q_models, q_stats, q_trees  # noqa: F401
from exposa.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
