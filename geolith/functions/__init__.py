"""Column functions and small row helpers."""
