"""Plans compiled to DataFrame operations."""
