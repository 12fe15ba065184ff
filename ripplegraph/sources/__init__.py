"""Readers of project artifacts."""
