"""Whole reports, and the queries of the driver contract."""
