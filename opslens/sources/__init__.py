"""Reading operational tables and writing results."""
