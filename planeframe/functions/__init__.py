"""Column functions: pixel layout, names, text and timing."""
