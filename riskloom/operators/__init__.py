"""Batch operators over transactions, alerts and graphs."""
