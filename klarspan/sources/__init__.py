"""Scans of repositories, wiki markup, nested documents and model dumps, and the sinks that hold a run's tables."""
