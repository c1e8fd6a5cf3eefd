"""Text extraction, cleaning, chunking and layout analytics on PySpark DataFrames."""
