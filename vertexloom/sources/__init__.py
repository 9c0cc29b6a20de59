"""Loading, storing and naming graphs."""
