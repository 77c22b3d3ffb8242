"""Composed plans: secured views and the registered queries."""


def catalog_of_queries():
    """``(queries, oracles)`` with every query module loaded."""
    from wardline.plans import (  # noqa: F401
        queries_catalogue,
        queries_functions,
        queries_governance,
        queries_relational,
        queries_semantic,
    )
    from wardline.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
