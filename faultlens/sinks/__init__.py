"""Writers for the output tables."""
