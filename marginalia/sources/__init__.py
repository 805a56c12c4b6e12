"""Sources and sinks: stage files, files on disk, and the derived views of the input tables."""
