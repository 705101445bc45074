"""Registries, query plans, their validation and their split into segments."""
