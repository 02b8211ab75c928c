"""weftline: prepares language-model context with Spark DataFrames."""
