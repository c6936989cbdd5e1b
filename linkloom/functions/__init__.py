"""linkloom functions."""
