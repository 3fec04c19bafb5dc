"""gleanery."""
