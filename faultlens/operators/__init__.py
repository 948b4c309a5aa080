"""DataFrame-to-DataFrame operators of the failure analysis."""
