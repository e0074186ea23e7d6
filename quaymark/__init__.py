"""Storage-posture analytics on Spark: findings, correlation and scoring as relational plans."""
