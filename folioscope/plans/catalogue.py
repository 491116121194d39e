"""All registered queries and their SQL."""

from __future__ import annotations

from . import analysis, bibliometry, impact, landing, records  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
