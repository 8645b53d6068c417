"""Sources and sinks: documents, web pages, parent store, exports."""
