"""Reading files and text, and writing text."""
