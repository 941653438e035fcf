"""Plans: the stored snapshot, enrichment, rendering and the whole flow."""
