"""Reading and writing records and tables."""
