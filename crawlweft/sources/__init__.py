"""Sources: crawl tables from fetched pages."""
