"""File inventories, manifests and the run log."""
