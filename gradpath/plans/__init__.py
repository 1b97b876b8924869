"""Whole answers, one per service endpoint, composed from the operators."""
