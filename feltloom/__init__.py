"""Decision-log analytics expressed as plain DataFrame-to-DataFrame functions."""
