"""Column expressions: everything here takes and returns a Column."""
