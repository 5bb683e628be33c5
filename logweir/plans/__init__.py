"""Whole plans made of the operators."""
