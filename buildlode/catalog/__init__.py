"""Named queries over a data folder and the SQL each is checked against."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import tables, relational, landed, learning, incremental, studies  # noqa: F401  (register queries)
