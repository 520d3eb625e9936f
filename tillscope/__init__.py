"""Seller analytics on Spark: payments, churn, growth, segments and journeys."""
