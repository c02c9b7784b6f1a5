"""The scans over streams."""
