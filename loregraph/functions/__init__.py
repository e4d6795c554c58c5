"""Column expressions; nothing in here plans a shuffle."""
