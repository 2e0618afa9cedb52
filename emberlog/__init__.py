"""emberlog: a Spark-native analytics engine over an append-only, schema-flexible event log."""

__version__ = "0.1.0"
