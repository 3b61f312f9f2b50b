"""Column functions: matching, checksums, masks, aliases."""
