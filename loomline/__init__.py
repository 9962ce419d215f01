"""loomline: web-content extraction and run analytics on PySpark."""
