"""The subpackage's queries and their SQL."""

from . import audit, bpe, fingerprint, minhash, ngram_join, packing, pitman_yor, quality, sharding, sstable, substring, trie, urls

QUERIES = {f.__name__: f for f in (substring.op1_substring_dedup, minhash.op3_minhash_near_dedup, fingerprint.op5_winnowing, pitman_yor.op6_pitman_yor, bpe.op7_byte_bpe, quality.op2_quality_rules, urls.op4_url_filters, sstable.op8_sstable_shards, sharding.op9_minimax_sharding, packing.op10_nnls_packing, ngram_join.op11_ngram_join, trie.op12_prefix_trie, audit.op13_filter_audit)}
ORACLES: dict[str, str] = {"op3_minhash_near_dedup": minhash.OP3_SQL, "op4_url_filters": urls.OP4_SQL, "op11_ngram_join": ngram_join.OP11_SQL, "op12_prefix_trie": trie.OP12_SQL, "op13_filter_audit": audit.OP13_SQL}
