"""Keyed state: source health, feedback logs and windows, in batch and as streams."""
