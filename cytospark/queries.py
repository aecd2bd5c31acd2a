"""All registered queries of the engine and the SQL they are held against."""

from .plans.catalogue import ORACLE, QUERIES
from .plans import control, files  # noqa: F401  (register their queries)

__all__ = ["ORACLE", "QUERIES"]
