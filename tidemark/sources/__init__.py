"""Sources: table loading, synthetic grids and the logical tables built from stored ones."""
