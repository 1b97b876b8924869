"""Scoring of arriving profiles."""
