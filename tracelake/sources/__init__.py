"""Readers that turn tool output into trace tables."""
