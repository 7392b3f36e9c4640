"""emberflow: sparse-feature embedding dataflow on Spark DataFrames."""

__version__ = "0.1.0"
