"""corpusloom: code- and text-corpus analytics on Spark DataFrames."""
