"""Ready-made end-to-end queries and their SQL counterparts."""
