"""Query plans over the tables."""
