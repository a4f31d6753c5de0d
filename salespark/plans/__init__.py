"""Named queries: the parameterised API, report rows, and the checked query catalogue."""
