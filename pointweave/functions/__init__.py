"""Part of the pointweave engine."""
