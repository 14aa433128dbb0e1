"""Runnable queries over the star-schema tables, each with equivalent SQL where SQL can express it."""

from wattweave.catalog import aggregation, distribution, imputation, jobs, modelling, relational, scalars, scans
from wattweave.catalog.base import ORACLES, RUNS

__all__ = ["ORACLES", "RUNS", "aggregation", "distribution", "imputation", "jobs", "modelling", "relational",
           "scalars", "scans"]
