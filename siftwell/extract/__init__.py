"""Extractors: one file to definitions and references."""
