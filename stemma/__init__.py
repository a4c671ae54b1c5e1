"""stemma: evidence-graph analytics as lazy Spark transformations."""
