"""All registered queries: importing the modules registers them."""

from . import evaluation, language, linking, records  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
