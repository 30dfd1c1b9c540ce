"""Spark-native preparation, profiling and modelling of tables.

Every operator takes a DataFrame and returns a DataFrame. Where an operator needs
statistics first (a median, a set of bounds, a category list) it is split in two:
``fit_*`` runs aggregates and returns a few values, ``apply_*`` is one projection
with those values as literals, so it also works on a stream.
"""

from gridwright.constants import CLASSIFICATION, REGRESSION
from gridwright.plans.workspace import Workspace

__all__ = ["CLASSIFICATION", "REGRESSION", "Workspace"]
