"""Numpy kernels that run inside tasks."""
