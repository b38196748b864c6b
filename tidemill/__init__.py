"""tidemill: a Spark-native engine that turns collected search payloads into
canonical records, removes duplicates, numbers, merges, audits and exports them."""

__all__ = ["__version__"]
__version__ = "0.1.0"
