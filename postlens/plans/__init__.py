"""Named query plans: each pairs a Spark DataFrame builder with oracle SQL."""

from postlens.plans.registry import QUERIES, ORACLE, register  # noqa: F401
from postlens.plans import q_core, q_stats, q_trend, q_advise, q_text, q_learn, q_stream, q_scored  # noqa: F401  (registers on import)
