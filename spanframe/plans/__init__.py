"""Plan builders shared by the operators: ordered scans, interval joins, rounds."""
