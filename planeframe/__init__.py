"""planeframe: scientific image streams as Spark DataFrames, one row for each image plane."""

__version__ = "0.1.0"
