"""All registered queries and their twins."""

from flowlens.plans import (  # noqa: F401
    queries_alerts,
    queries_files,
    queries_labels,
    queries_models,
    queries_scalars,
    queries_streams,
)
from flowlens.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
