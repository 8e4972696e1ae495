"""Evidence analytics as Spark dataflows."""
