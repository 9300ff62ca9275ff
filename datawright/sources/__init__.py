"""Sources and identity of rows and versions."""
