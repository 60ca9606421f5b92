"""Runnable queries over the shared tables, each with an equivalent SQL text."""
