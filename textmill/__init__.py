"""textmill: corpus preparation and evaluation operators on Spark DataFrames.

Every operator takes and returns DataFrames.  Ordered operators (budgets,
mixing, packing, running windows) carry an explicit total order key and use
two-level (bucket, in-bucket) computations so that no step needs a single
partition holding a whole group.
"""

from textmill.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
