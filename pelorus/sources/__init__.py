"""Sources: tables, files and inline rows."""
