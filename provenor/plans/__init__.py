"""Whole steps of the evidence ranking, composed from the operators."""
