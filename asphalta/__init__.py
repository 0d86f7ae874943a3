"""Road-safety analytics on Spark DataFrames.

Every operator is a function from DataFrames to DataFrames with column names
as parameters.  Nothing row-level is brought to the driver.
"""
