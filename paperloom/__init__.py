"""paperloom: DataFrame operators that profile, name and clean document corpora on Spark."""

__version__ = "0.1.0"
