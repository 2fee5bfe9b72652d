"""All queries of the library by name, with the SQL that checks them."""

from sillage.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
