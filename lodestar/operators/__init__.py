"""The algebra's nodes as DataFrame operations."""
