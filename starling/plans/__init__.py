"""Named queries over the base tables, each with its SQL equivalent where SQL can express it."""
