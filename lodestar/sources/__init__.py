"""Tables by name."""
