"""Plan shapes: sliced windows, size checks, whole analyses."""
