"""Scene arrival as a stream."""
