"""Column-level functions: distances, kernels, index arithmetic."""
