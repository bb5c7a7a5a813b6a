"""Document-graph analytics as PySpark DataFrame programs."""
