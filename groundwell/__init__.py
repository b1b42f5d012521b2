"""groundwell: retrieval, ingestion and evaluation over tables of documents and questions, on Spark."""
