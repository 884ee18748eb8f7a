"""Query plans registered for the driver."""
