"""barloom: price-panel feature, label, validation and back-test jobs for Spark."""
