"""Pieces of DuckDB SQL that several oracles use."""

SEQS = """seqs AS (SELECT source AS file, lang AS domain, doc_id AS record_idx, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS seq FROM documents)"""
SEQS_R = """seqs AS (SELECT source AS file, lang AS domain, doc_id AS record_idx,
  CASE WHEN doc_id % 17 = 0 THEN regexp_replace(upper(text), '[^ACGTNR]', '', 'g') ELSE regexp_replace(upper(text), '[^ACGTN]', '', 'g') END AS seq FROM documents)"""


def count_of(seq: str, symbols: str) -> str:
    return f"(length({seq}) - length(translate({seq}, '{symbols}', '')))"


def rc(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGTacgt', 'TGCAtgca'))"


def entropy(seq: str) -> str:
    term = lambda s: f"CASE WHEN {count_of(seq, s)} > 0 THEN -({count_of(seq, s)} / length({seq})::DOUBLE) * log2({count_of(seq, s)} / length({seq})::DOUBLE) ELSE 0 END"
    return f"CASE WHEN length({seq}) > 0 THEN {' + '.join(term(s) for s in 'ACGTN')} ELSE 0 END"


def uniform(seed, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
