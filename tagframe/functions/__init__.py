"""Column functions: catalogues of codes, binary decoding and encoding, conversions, tile geometry."""
