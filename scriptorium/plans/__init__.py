"""End-to-end compositions users call."""
