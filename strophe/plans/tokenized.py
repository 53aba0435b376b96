"""Queries of token ids under a public vocabulary; SQL holds their round trips to the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.operators import vocab
from strophe.plans.registry import query

#: Section marks as special tokens after the vocabulary's ids.
_SPECIALS = ["[start]", "[end]", "[verse]", "[verse 2]", "<SOA>", "<EOA>"]


def _load():
    import public_tokenizers as public

    return vocab.byte_encoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, {t: 50_300 + i for i, t in enumerate(_SPECIALS)})


_MARKED = "'[start][verse' || CASE WHEN doc_id % 2 = 0 THEN ' 2]' ELSE ']' END || text || '<SOA><EOA>[ver[end]'"


@query(f"""SELECT doc_id, {_MARKED} AS back, sha256('[start]' || ' [verse' || CASE WHEN doc_id % 2 = 0 THEN ' 2] ' ELSE '] ' END || text) AS head, [50300, CASE WHEN doc_id % 2 = 0 THEN 50303 ELSE 50302 END, 50304, 50305, 50301] AS marks FROM documents""")
def token_round_trip(t):
    load = _load()
    d = t("documents").select("doc_id", F.expr(_MARKED).alias("marked")).withColumn("ids", vocab.byte_ids(F.col("marked"), load))
    back = d.select("doc_id", "ids", vocab.byte_text(F.col("ids"), load).alias("back"), vocab.byte_text(F.col("ids"), load, spaced=True).alias("spaced"))
    head = F.concat(F.lit("[start]"), F.regexp_extract("spaced", r"(?s)^ \[start\] ( \[verse(?: 2)?\] .*) <SOA>  <EOA> \[ver \[end\] $", 1))
    return back.select("doc_id", "back", F.sha2(head, 256).alias("head"), F.filter("ids", lambda x: x >= 50_300).alias("marks"))



@query("""SELECT doc_id, [503, 511, 511, 504, 511, 511, 512, 511] AS structure, rtrim(ltrim(text, ' '), ' ') AS words FROM documents""")
def lyric_line_ids(t):
    load = _load()
    encode = lambda: load().encode
    lines = F.array(F.lit("[verse]"), F.col("text"), F.lit("[chorus]"), F.lit(""), F.lit("[space]"))
    ids = t("documents").select("doc_id", vocab.line_ids(lines, encode).alias("ids")).withColumn("n", F.size("ids"))
    body = F.slice("ids", F.lit(3), F.col("n") - 8)
    marks = F.concat(F.slice("ids", 1, 2), F.slice("ids", F.col("n") - 5, F.lit(6)))
    return ids.select("doc_id", marks.alias("structure"), vocab.byte_text(body, load).alias("words"))
