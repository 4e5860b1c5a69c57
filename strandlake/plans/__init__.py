"""Workloads composed of several operators."""
