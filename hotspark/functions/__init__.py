"""Column functions and small numpy kernels."""
