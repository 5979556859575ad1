"""DataFrame operators: joins, aggregates, diffs, filters and rankings."""
