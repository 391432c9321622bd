"""strandframe: denominator-aware interval, sequence and comparative statistics on Spark DataFrames."""
