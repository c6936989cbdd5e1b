"""linkloom streaming."""
