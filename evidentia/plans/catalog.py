"""All registered queries."""

from evidentia.plans import q_chunking, q_composed, q_grounding, q_ingest, q_live, q_questions, q_reports, q_retrieval, q_streams  # noqa: F401
from evidentia.plans.registry import QUERIES, checks  # noqa: F401
