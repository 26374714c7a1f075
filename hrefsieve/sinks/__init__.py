"""Writers for reports, URL lists and inventories."""
