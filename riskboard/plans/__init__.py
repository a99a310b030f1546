"""Registered queries with the SQL that states the same result."""

from . import boards, evidence, people, snapshots, streams, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
