"""Registered queries of the cube engine, each with the SQL that says the same in another way where there is one."""

from cubespark.queries import cubes, indices, pipelines, sampling, spatial, stats  # noqa: F401
from cubespark.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
