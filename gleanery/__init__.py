"""Knowledge retrieval, curation and corpus preparation on Spark."""
