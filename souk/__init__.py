"""souk: marketplace order analytics on Spark (DataFrame API only)."""

__version__ = "0.1.0"
