"""Named queries over the driver tables, each with an independent SQL form."""
