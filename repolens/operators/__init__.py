"""Frame -> frame operators of the four index layers and of the queries that read them."""
