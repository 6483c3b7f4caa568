"""Batch jobs over many small operational and personal-finance books."""
