"""Preparation, counting and mining operators."""
