"""Sources: dimension tables from configuration, run tables from files, and
relations derived from the driver's benchmark tables."""
