"""All registered queries."""

from __future__ import annotations

from waymark.plans import build_queries, check_queries, file_queries, number_queries, page_queries, reply_queries, report_queries, scoring_queries, text_queries  # noqa: F401
from waymark.plans.registry import QUERIES, SQL  # noqa: F401
