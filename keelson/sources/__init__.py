"""Sources and sinks: binary segment files, manifests, reports."""
