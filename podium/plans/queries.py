"""All registered queries."""

from . import queries_compare, queries_json, queries_more, queries_quality, queries_rank, queries_source, queries_text  # noqa: F401
from .catalogue import ORACLES, QUERIES  # noqa: F401
