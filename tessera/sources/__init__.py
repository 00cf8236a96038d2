"""Inputs and outputs: strict JSON catalogues, alias files, Markdown lists, published files."""
