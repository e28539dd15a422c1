"""quillmere: an analytics engine of named queries over Spark DataFrames."""
