"""Relational operators over scenes, tiles, pixels and pairs of images."""
