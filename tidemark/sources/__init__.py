"""Sources: driver tables as bars and observations, and the bitemporal store."""
