"""Column functions shared by operators and queries."""
