"""crashlens: incident analytics on Spark DataFrames.

Layout:
  sources/    load and write steps, table schemas, sample views over the test tables
  functions/  column predicates (case-insensitive, placeholder-aware)
  operators/  reusable DataFrame operators (dedup, joins, group tests, ranking, profiling)
  plans/      the ten questions and the run-all job
"""

from crashlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
