"""linkloom sources."""
