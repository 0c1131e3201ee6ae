"""Flow and session analytics as DataFrame and SQL plans."""
