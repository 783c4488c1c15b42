"""Claimlake: claim verification datasets and corpus preparation as Spark jobs."""
