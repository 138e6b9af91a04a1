"""Registered queries and the equivalent SQL, grouped by operator family."""
