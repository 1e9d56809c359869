"""Training-data operators: language ID, near-duplicate joins, packing, PII, quality, fingerprints,
decontamination, HTML extraction, substring dedup and license scans. Nothing else imports this package."""
