"""DataFrame operators: filters, lookups and joins, aggregations, ordering, ingest, indels."""
