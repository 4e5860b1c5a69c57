"""Registered queries: operators applied to the canonical views, beside their SQL."""
