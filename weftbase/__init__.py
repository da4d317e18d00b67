"""PySpark jobs for document knowledge bases."""
