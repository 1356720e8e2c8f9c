"""Disease-surveillance analytics as PySpark DataFrame and streaming jobs."""
