"""Relational operators: joins, clustering, splits, statistics, baselines."""
