"""Waymark: DataFrame jobs over pages, link graphs, trails, tool replies and tool-call logs."""
