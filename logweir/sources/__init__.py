"""Log files and texts in, tables and files out."""
