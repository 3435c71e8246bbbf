"""The same analyses over streams."""
