"""topicloom: topic analytics as Spark plans.

Every operator takes DataFrames and returns a DataFrame.  Row-sized data stays
distributed; only tables whose size is checked first are broadcast.
"""

__version__ = "0.1.0"
