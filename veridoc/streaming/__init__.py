"""Run events as text and as streams."""
