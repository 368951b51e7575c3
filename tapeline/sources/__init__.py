"""Topic contracts, readers, writers and the table adapters."""
