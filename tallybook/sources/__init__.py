"""Reading and writing: text feeds, curated files, stored tables."""
