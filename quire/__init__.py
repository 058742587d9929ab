"""Document, annotation and bibliography analytics as PySpark DataFrame jobs."""
