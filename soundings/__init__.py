"""Soundings: ocean-model validation against observations, as Spark jobs.

Every operator is a plain function from DataFrames to a DataFrame.  Nothing is
collected to the driver; a missing value is NULL everywhere (NaN is turned into
NULL once, when data is read).
"""
