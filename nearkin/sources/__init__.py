"""Reading and writing the tables of one embedding model."""
