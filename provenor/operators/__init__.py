"""DataFrame operators; see each module."""
