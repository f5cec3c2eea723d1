"""All registered queries."""

from workload import (  # noqa: F401
    drift_forms,
    keyword_survey,
    prompt_log,
    recall_routing,
    streams,
    text_checks,
    work_log,
)
from workload.registry import QUERIES, SQL  # noqa: F401
