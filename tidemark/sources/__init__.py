"""Sources: REST pages, files, sweeps over vendor payloads."""
