"""Code-intelligence and change-analysis operators on PySpark DataFrames."""
