"""quirefold: compare many long documents by question, on Spark DataFrames."""
