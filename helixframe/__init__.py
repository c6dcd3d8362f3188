"""Coding-sequence analytics and corpus operators expressed as Spark jobs."""
