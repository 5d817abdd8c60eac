"""Halfspace range search and sparse attention as DataFrame plans."""
