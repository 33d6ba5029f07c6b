"""Named queries over the tables, each with SQL of its own where SQL can express it."""
