"""Governed analytics on Spark: secured views, access decisions, catalogue and semantic jobs."""

from wardline.plans.secured import GovernedSession
from wardline.operators.rowfilters import FilterContext, FilterPlan, RowFilterRegistry, Subject
from wardline.session import build_session, configure

__all__ = [
    "FilterContext",
    "FilterPlan",
    "GovernedSession",
    "RowFilterRegistry",
    "Subject",
    "build_session",
    "configure",
]
