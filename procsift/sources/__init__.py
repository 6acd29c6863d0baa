"""Raw-log scans, normalisation, stored artifacts, analyst intake and sinks."""
