"""Scans, ledgers, fingerprints and manifests."""
