"""Where layers come from and where they go."""
