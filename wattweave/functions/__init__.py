"""Column functions: null-strict statistics, date parts, label rules and row vectors."""
