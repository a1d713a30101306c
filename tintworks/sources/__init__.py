"""Image and table sources, and sinks."""
