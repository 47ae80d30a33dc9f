"""DataFrame -> DataFrame operators, shared by batch, backfill and streams."""
