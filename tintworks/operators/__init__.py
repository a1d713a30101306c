"""Relational operators over pixels, samples and candidate palettes."""
