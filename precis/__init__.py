"""precis: summary-evaluation and prompt-experiment analytics on Spark.

Every operator takes DataFrames (or Columns) and returns a DataFrame (or
Column).  Work is expressed with Spark SQL built-ins first; Arrow-batched
pandas functions are used only where no built-in exists (Unicode NFKD,
HTML entity decoding, Porter stemming of a distinct vocabulary, LCS).
"""

__all__ = ["session"]
