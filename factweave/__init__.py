"""factweave: evidence-graph retrieval, evaluation and data processing on Spark."""
