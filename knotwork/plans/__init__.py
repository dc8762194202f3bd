"""Plan-level helpers: where intermediate tables go and how they are cut."""
