"""Options, whole runs and reports."""
