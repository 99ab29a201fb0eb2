"""corpuscount: exact corpus counting and measurement on Spark DataFrames."""
