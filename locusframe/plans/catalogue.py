"""All core queries and their SQL twins."""

from __future__ import annotations

from . import files, numbered, reference

QUERIES = {**numbered.QUERIES, **reference.QUERIES, **files.QUERIES}
ORACLE = {**numbered.ORACLE, **reference.ORACLE, **files.ORACLE}
