"""Sessions, tables and the catalogue of registered queries."""
