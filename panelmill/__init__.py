"""panelmill: monthly (entity x category) panel analytics on PySpark DataFrames."""
