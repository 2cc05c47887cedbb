"""Posting ingest and résumé gap analysis, expressed as Spark jobs."""
