"""Offer search and analytics on Spark."""
