"""Training-data operators: ten large-scale text operations built on DataFrames."""
