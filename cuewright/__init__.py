"""Spark-native analytics for time-aligned text: words, cues, subtitles and transcripts.

Operators take and return DataFrames and are lazy unless their docstring says otherwise.
"""

__version__ = "0.1.0"
