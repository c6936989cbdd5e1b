"""linkloom operators."""
