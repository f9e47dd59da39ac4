"""The registered queries: thin calls of the operators over whole tables."""

from __future__ import annotations

from quarryleaf.llm.common import table

#: Of the registered query where the session names no key: results are then
#: linkable by anyone, and are for tests only.
PII_KEY = b"quarryleaf example key, not secret"


def op1_decontamination(spark, sf_dir):
    from quarryleaf.llm import decontaminate

    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark, sf_dir):
    from quarryleaf.llm import toxicity

    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark, sf_dir):
    from quarryleaf.llm import pii

    return pii.digest(table(spark, sf_dir, "documents"), (spark.conf.get("quarryleaf.pii.key", None) or PII_KEY.decode()).encode())


def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from quarryleaf.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_language_id(spark, sf_dir):
    import public_tokenizers

    from quarryleaf.llm import langid

    return langid.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_order_minhash(spark, sf_dir):
    from quarryleaf.llm import orderhash

    return orderhash.digest(table(spark, sf_dir, "documents"))


def op7_secrets(spark, sf_dir):
    from quarryleaf.llm import secrets

    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    from quarryleaf.llm import warc

    return warc.digest(table(spark, sf_dir, "pages"))


def op9_simhash(spark, sf_dir):
    from quarryleaf.llm import simhash

    return simhash.digest(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    from quarryleaf.llm import linededup

    return linededup.digest(table(spark, sf_dir, "documents"))


_ALL = (op1_decontamination, op2_toxicity, op3_pii, op4_byte_bpe, op5_language_id, op6_order_minhash, op7_secrets, op8_warc, op9_simhash, op10_line_dedup)
QUERIES = {f.__name__: f for f in _ALL}
