"""Scoring plans: hosts, network, reports and whole runs."""
