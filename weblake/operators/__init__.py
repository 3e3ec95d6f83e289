"""Relational operators over pages, nodes, links, images and the crawl frontier."""
