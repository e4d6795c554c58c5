"""The engine's operators on the given tables, with the same results stated in SQL."""
