"""Column expressions; all of them work on streams as well."""
