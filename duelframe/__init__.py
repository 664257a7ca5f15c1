"""Match analytics on Spark: DataFrame-to-DataFrame operators and the jobs made of them."""

from duelframe.session import apply_settings, build_session

__all__ = ["apply_settings", "build_session"]
