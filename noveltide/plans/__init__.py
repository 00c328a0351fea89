"""Queries over whole tables, composed of operators."""
