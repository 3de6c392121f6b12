"""Every registered query of the core."""

from docaudit.plans import audit_queries, context_queries, field_queries, passport_queries, raster_queries, record_queries, score_queries, stream_queries, text_queries  # noqa: F401
from docaudit.plans.registry import QUERIES, SQL  # noqa: F401
