"""A Spark-first engine that triages document collections and measures how well the triage works."""
