"""Code-knowledge-graph analytics and corpus preparation on Spark."""
