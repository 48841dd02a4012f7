"""The ten questions and the job that runs them."""

from crashlens.plans.questions import (QUESTIONS, q1, q2, q2_count, q3, q4, q4_count, q5, q6,
                                       q7, q8, q9, q9_count, q10)
from crashlens.plans.tables import Incidents

__all__ = ["QUESTIONS", "Incidents", "q1", "q2", "q2_count", "q3", "q4", "q4_count", "q5",
           "q6", "q7", "q8", "q9", "q9_count", "q10"]
