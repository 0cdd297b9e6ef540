"""Column expressions and numpy kernels of the signal codec."""
