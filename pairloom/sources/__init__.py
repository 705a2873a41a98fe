"""Readers and writers of scenes; a Python data source with a partition for each tile."""
