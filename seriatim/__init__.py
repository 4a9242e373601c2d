"""seriatim: a PySpark-native engine for stratified retrieval evaluation and event-table preparation."""

__version__ = "0.1.0"
