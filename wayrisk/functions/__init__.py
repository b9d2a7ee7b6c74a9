"""Part of the transport-risk library."""
