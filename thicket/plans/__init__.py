"""Parameters and registered queries."""
