"""Table exploration on Spark: clean, type, profile, chart, pivot and screen tables of any size."""

from lucarne.session import get_session, use_utc

__all__ = ["get_session", "use_utc"]
