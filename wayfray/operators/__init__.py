"""Operators on networks, zones and sweeps."""
