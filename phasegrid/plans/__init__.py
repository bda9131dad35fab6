"""End-to-end jobs: from parsed packets to products."""
