"""Composite plans: candidates, editions, retrospectives; and the queries over the driver's tables."""
