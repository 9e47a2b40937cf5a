"""docsieve: Spark jobs for question answering over document collections."""
