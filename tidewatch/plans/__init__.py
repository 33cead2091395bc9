"""Use cases composed from sources and operators, and their reports."""
