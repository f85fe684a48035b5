"""Whole jobs built from the operators, and the catalog of registered queries."""
