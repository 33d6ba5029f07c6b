"""Readers and writers: vaults of files, TEI, paper feeds, routes, audit logs."""
