"""Bindings of the given tables to the engine's inputs, the registered queries and their SQL."""
