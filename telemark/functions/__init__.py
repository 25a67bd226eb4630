"""Column functions (``Column -> Column``): predicates, time, aggregates, text, enrichment."""
