"""Where tables are read from."""
