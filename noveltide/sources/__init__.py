"""Readers, writers and the harvest connector."""
