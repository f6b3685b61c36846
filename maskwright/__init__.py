"""maskwright: finding and replacing sensitive values in text, as Spark DataFrames."""
