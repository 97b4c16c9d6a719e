"""Multi-seller price analytics and corpus preparation on Spark."""
