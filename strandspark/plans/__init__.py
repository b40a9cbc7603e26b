"""Queries of the library over the driver's tables, with independent SQL for each."""
