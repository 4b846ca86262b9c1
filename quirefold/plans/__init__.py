"""Composed runs and the registered queries."""
