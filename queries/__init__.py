"""The operators run on the star-schema tables, each beside the SQL that checks it."""
