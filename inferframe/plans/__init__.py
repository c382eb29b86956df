"""Whole plans: the query catalogue, its SQL, and the batch pipeline."""
