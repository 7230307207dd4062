"""The same work on crawl files as they land."""
