"""Registered queries of the read operators, each with its SQL."""
