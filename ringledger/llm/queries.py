"""The queries of the training-data operators, and their SQL where it can express them."""

from . import chat_format, decontaminate, embedding_join, fill_in_middle, html_extract, jaccard_join, lm_scoring, quality, sentencepiece_codec, sharding, spelling, token_counts, url_filter

MODULES = [embedding_join, url_filter, decontaminate, sentencepiece_codec, jaccard_join, sharding, quality, token_counts, html_extract, lm_scoring, spelling, fill_in_middle, chat_format]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
