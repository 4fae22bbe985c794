"""Sources and sinks: files to DataFrames, natural keys to element ids and back."""
