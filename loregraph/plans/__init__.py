"""Composite plans: what a user of the engine calls."""
