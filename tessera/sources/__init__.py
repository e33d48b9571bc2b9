"""Sources: folders of files as document tables, CSV renderings, tolerant JSON readers."""
