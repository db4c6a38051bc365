"""Sources and sinks: test-table adapters and file formats."""
