"""Where raw logs come from and where results go."""
