"""Queries over the driver's tables. Importing this package registers them all."""

from . import analytics, compile, files, formatting, profile, reach, report, runs, sequences  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
