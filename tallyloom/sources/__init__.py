"""Sources and job records."""
