"""basemill: quality control and preprocessing of sequencing reads on Spark DataFrames."""

__version__ = "0.1.0"
