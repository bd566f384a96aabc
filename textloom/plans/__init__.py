"""Session helpers, shared scratch tables and size-checked broadcasts."""
