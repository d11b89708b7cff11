"""Column functions: cleaning, clock and calendar features."""
