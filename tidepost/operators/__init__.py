"""DataFrame-to-DataFrame operators over the posting registry."""
