"""End-to-end plans: images to support tables, problems to palettes."""
