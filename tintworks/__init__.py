"""Colour-palette analytics on Spark: pixels to weighted samples, chroma caps, and constraint-driven palettes."""
