"""Named queries over the star schema, each with its SQL where SQL can express it."""

from terraquill.catalog import aggregate_queries, join_queries, pipeline_queries, review_queries, rule_queries, spatial_queries, text_queries  # noqa: F401
from terraquill.catalog.base import QUERIES, SQL  # noqa: F401
