"""linkloom plans."""
