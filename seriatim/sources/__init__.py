"""Landed crawl tables in, catalogue tables out."""
