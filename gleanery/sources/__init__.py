"""Readers with explicit schemas and versions, and writers that never half-write."""
