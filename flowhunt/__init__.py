"""Flow-metadata threat analytics on Spark DataFrames."""

from flowhunt.session import build_session, materialize, prepare

__all__ = ["build_session", "materialize", "prepare"]
