"""Chains of operators, and the named queries over the test tables."""
