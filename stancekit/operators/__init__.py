"""DataFrame -> DataFrame operators (compose with ``df.transform``)."""
