"""All registered queries of the library."""

from . import behaviour, integrity, structure, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
