"""Selective range analytics over columns: block-skipping access paths as DataFrame plans."""
