"""Reading and writing CSV and JSON."""
