"""Access-governance analytics over catalog snapshots, as Spark DataFrames."""

__version__ = "0.1.0"
