"""Urban planning analytics on PySpark DataFrames."""
