"""maskwright: see README."""
