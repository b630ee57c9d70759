"""Question answering and corpus analytics over text tables, on Spark DataFrames."""
