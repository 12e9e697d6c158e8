"""Composed plans: the dashboard pages and the registered, oracle-checked queries."""
