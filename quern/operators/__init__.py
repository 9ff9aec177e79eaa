"""What is done with rows: reads, aggregates, relations, writes, hand-written SQL."""
