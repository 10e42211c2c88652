"""All named queries; importing the modules registers them."""

from tidemark.plans.registry import QUERIES, SQL
from tidemark.plans import report_queries  # noqa: F401
from tidemark.plans import feature_queries  # noqa: F401
from tidemark.plans import post_queries  # noqa: F401
from tidemark.plans import metric_queries  # noqa: F401
from tidemark.plans import source_queries  # noqa: F401
from tidemark.plans import model_queries  # noqa: F401
from tidemark.plans import file_queries  # noqa: F401
