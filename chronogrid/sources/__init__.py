"""Reading and writing panels, and panels derived from star-schema tables."""
