"""Readers of site data, and writers of published results."""
