"""The query catalogue: importing it registers every query."""

from . import corpus, evaluation, relational  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
