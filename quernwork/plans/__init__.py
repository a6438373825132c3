"""The registered queries and the SQL each is checked against."""

from quernwork.plans.registry import Query, registered

__all__ = ["Query", "registered"]
