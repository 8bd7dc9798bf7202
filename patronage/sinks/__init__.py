"""Writers for files, databases and the BI mart."""
