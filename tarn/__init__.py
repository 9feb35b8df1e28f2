"""tarn: full-text search, crawl-frontier and corpus analytics as Spark DataFrames.

The package holds logical plans only; Catalyst and AQE choose how they run.
"""

__version__ = "0.1.0"
