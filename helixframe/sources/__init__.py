"""Readers of record, split, report and text inputs."""
