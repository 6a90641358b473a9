"""Incremental capture: new content arrives as a stream of files and is admitted once by its content key."""
