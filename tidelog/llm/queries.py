"""Queries of the training-data operators, as registered, and their SQL where SQL can express them."""

from tidelog.llm import base_sql, bpe, decontam, jaccard, langid, media, pii, secrets, toxicity, urls, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_secrets": secrets.op2_secrets,
    "op3_media": media.op3_media,
    "op4_bpe": bpe.op4_bpe,
    "op5_revisits": warc.op5_revisits,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_langid": langid.op7_langid,
    "op8_urls": urls.op8_urls,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_toxicity": toxicity.op10_toxicity,
}

#: Columns of three of these queries that SQL can express, though not the whole rows.
_PARTS = {
    "pii_base": ("op1_pii", ["doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256"]),
    "secrets_base": ("op2_secrets", ["doc_id", *[f"n_{k}" for k in secrets.KINDS], "base_sha256"]),
    "media_payloads": ("op3_media", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256"]),
}
QUERIES |= {name: lambda spark, d, of=of, columns=columns: QUERIES[of](spark, d).select(columns) for name, (of, columns) in _PARTS.items()}
ORACLE_SQL: dict[str, str] = {
    "pii_base": base_sql.PII_BASE,
    "secrets_base": base_sql.SECRETS_BASE,
    "media_payloads": base_sql.MEDIA_PAYLOADS,
    "op5_revisits": warc.OP5_SQL,
    "op6_decontaminate": decontam.OP6_SQL,
    "op8_urls": urls.OP8_SQL,
    "op9_jaccard": jaccard.OP9_SQL,
}
