"""DataFrame-to-DataFrame operators: cleaning, checks, dimension and fact builders, merging, ranking."""
