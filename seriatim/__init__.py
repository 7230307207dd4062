"""Catalogues of serialised web publications, as Spark jobs over landed crawl tables."""
