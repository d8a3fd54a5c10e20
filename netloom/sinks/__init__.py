"""Graphs, netlists, schematics and labels as files."""
