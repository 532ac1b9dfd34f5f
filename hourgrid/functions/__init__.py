"""Column expressions, exact quantiles and per-frame kernels."""
