"""Registered queries and, where SQL can express them, DuckDB SQL that gives the same rows."""

from . import bandit, inventory, learning, streams

QUERIES = bandit.QUERIES | inventory.QUERIES | learning.QUERIES | streams.QUERIES
ORACLES = bandit.ORACLES | inventory.ORACLES | learning.ORACLES | streams.ORACLES
