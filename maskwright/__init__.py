"""maskwright: image-annotation analytics on Spark DataFrames."""
