"""Imports every catalogue module so that their queries register themselves."""

from reefline.plans import catalogue_basic, catalogue_draws, catalogue_panels, catalogue_review, catalogue_summaries, catalogue_survey  # noqa: F401
from reefline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
