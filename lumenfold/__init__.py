"""lumenfold: similarity search, track analytics and evaluation over embedded records, as Spark plans."""
