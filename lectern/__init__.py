"""Reading-corpus and reader-engagement analytics as PySpark jobs."""
