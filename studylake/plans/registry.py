"""Every query of the library by name, with the SQL that must agree with it."""

from __future__ import annotations

from . import catalog_queries, exam_queries, file_queries, layout_queries, log_queries, service_queries, text_queries  # noqa: F401  they register themselves
from .base import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "wrong_questions"
