"""Whole workflows, and the queries registered over the driver's tables."""
