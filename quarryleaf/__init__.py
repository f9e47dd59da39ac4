"""Query-focused page retrieval and text analytics on PySpark."""
