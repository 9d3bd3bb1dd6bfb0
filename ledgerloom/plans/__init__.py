"""Whole linkage plans."""
