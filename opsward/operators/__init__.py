"""Operators: pure ``DataFrame -> DataFrame`` functions, Catalyst does the planning."""
