"""Composed plans: bar tables over the shared test tables and the registered queries."""
