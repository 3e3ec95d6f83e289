"""Whole harvests, built from the operators."""
