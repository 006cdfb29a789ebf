"""cohera: sentence-order coherence data and metrics on Spark DataFrames."""

__version__ = "0.1.0"
