"""Registered queries over the shared tables, with an independent SQL text for each."""
