"""Document intelligence over large corpora, written as plain Spark DataFrame jobs."""
