"""Keeping the hourly profile up to date from a stream of flows."""
