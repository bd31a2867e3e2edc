"""Writers: versioned tables, point files, report and snapshot."""
