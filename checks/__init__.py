"""Independent SQL statements of the catalogue's queries."""
