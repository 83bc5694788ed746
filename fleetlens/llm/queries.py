"""Named queries of the training-data operators, each with its SQL twin or None."""

from fleetlens.llm import alignment, decontaminate, exact_dedup, license_scan, lm_scoring, mixing, ngram_join, packing, prefix_trie, quality, token_counts, url_filter, warc

TOPICS = [ngram_join, lm_scoring, quality, exact_dedup, decontaminate, packing, token_counts, license_scan, warc, url_filter, mixing, prefix_trie, alignment]
QUERIES = {name: entry for topic in TOPICS for name, entry in topic.QUERIES.items()}
