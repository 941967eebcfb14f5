"""Readers and writers: shards, outlines, marks blobs, raw pages, canonical sinks."""
