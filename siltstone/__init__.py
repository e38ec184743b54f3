"""Siltstone: knowledge-base indexing, retrieval and analytics as Spark jobs."""
