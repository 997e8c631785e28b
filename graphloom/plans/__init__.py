"""Whole plans over the operators."""
