"""tessera: embedding retrieval, graph post-processing, evaluation and profiling on Spark DataFrames."""

__version__ = "0.1.0"
