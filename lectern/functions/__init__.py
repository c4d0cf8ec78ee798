"""Column expressions, fixed values and model interfaces."""
