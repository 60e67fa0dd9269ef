"""Content-forensics analytics on PySpark: text and media signals over DataFrames of items."""
