"""Column functions: Catalyst expressions only, no Python workers."""
