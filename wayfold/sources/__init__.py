"""Sources and sinks: files and packet captures in, stage tables and reports out."""
