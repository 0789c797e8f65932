"""Java source from decoded classes, one class at a time."""
