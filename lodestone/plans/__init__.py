"""Graph catalogs and the registered queries."""
