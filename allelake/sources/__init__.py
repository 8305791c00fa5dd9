"""Readers of variant, region and listing files."""
