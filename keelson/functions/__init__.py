"""Column functions and seeded number generation."""
