"""Sources and sinks: archives, exports, bytes, document extraction, files."""
