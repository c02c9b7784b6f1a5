"""Package-threat analytics as DataFrame and Column expressions."""
