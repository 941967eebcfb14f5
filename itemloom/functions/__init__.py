"""Column-level functions: text, hashing, grading, and skew-proof window helpers."""
