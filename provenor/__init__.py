"""provenor: evidence-ranking operators for Spark DataFrames.

Every operator takes column names, returns a lazy DataFrame and leaves the
physical plan to Catalyst and adaptive execution.
"""
