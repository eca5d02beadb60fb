"""Incidences as streams: running degrees, windows of activity, and tables kept up to date batch by batch."""
