"""Warehouse plans: one function per fact, window or serving query."""
