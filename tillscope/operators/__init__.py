"""Relational building blocks: as-of join, periods, domains, top-k, day windows."""
