"""tracekit: Spark-native curation and evaluation of reasoning traces.

Every operator takes and returns DataFrames (or builds native Columns);
nothing iterates rows on the driver.
"""

__version__ = "0.1.0"
