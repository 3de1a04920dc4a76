"""Column functions and array kernels: vector arithmetic and bucket hashes."""
