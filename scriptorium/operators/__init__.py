"""Reusable table operators: spatial joins, matching, suppression, selection."""
