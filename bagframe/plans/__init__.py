"""All queries of the library outside bagframe.llm, with their SQL."""

from . import completed, further, learned, mixed, more, tiles, wholes  # noqa: F401  their queries enter the catalogue
from .catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
