"""Readers and writers for papers, words, manifests and worksheets."""
