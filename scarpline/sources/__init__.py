"""Readers, writers and the hazard views derived from the base tables."""
