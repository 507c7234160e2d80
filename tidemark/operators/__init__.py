"""DataFrame-to-DataFrame operators, by domain."""
