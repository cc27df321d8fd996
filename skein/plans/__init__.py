"""Session defaults and durable intermediate tables."""
