"""Training-data operators: token counts, search, joins, mixing, sharding and packing."""
