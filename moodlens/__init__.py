"""moodlens: post polarity analytics on Spark DataFrames.

Every analysis is a plain function from DataFrames to a DataFrame, so the same
code runs over an archive (batch) or inside a micro-batch (Structured
Streaming).  See README.md for the module map.
"""

__version__ = "0.1.0"
