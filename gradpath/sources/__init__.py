"""Readers, writers, saved models and the views derived from the supplied tables."""
