"""Readers: folders of documents to tables of nodes, edges, links, sections and metadata."""
