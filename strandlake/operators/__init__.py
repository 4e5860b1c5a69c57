"""Distributed operators over the canonical tables."""
