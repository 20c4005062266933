"""Following a source as it changes."""
