"""Queries of phonemes: syllables, Chinese words, learned conversion, phonemes of conversations, edit distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.operators import chinese, g2p, phonemes
from strophe.plans.registry import query

#: Characters that stand for the letters a to z, so that the tables' texts become runs of Chinese characters.
_LETTERS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "阿波次得鹅佛哥喝衣鸡科了摸呢哦坡七日思特屋迂挖西呀资"
_INITIALS = ["", "b", "d", "g", "h", "j", "l", "n", "q", "r", "s", "sh", "t", "w", "x", "y", "z", "zh", "ch", "c"]
_FINALS = ["a", "ai", "an", "ang", "ao", "e", "er", "i", "ia", "iang", "ie", "in", "ing", "iong", "iu", "o", "ong", "ou", "u", "ua", "uan", "ue", "ui", "un", "uo", "v", "ve", "n", "ng", "m", "r", ""]


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH s AS (SELECT p_partkey, {_list(_INITIALS)}[1 + p_partkey % {len(_INITIALS)}] || {_list(_FINALS)}[1 + (p_partkey // {len(_INITIALS)}) % {len(_FINALS)}] AS y, (p_partkey % 5 + 1) || '' AS tone FROM part),
e AS (SELECT *, CASE WHEN y IN ('n', 'ng', 'm') THEN 'e' || y ELSE y END AS z FROM s), r AS (SELECT *, CASE WHEN z LIKE '%r' THEN 'r' ELSE '' END AS r, regexp_replace(z, 'r$', '') AS p FROM e),
x AS (SELECT *, regexp_extract(p, '^[^aeiouv]*') AS a, regexp_extract(p, '[aeiouv].*$') AS b, p IN ('zi', 'ci', 'si', 'ri') AS hiss, p IN ('zhi', 'chi', 'shi') AS hush,
  p IN ('ya', 'yan', 'yang', 'yao', 'ye', 'yong', 'you') AS ia, p IN ('yi', 'yin', 'ying') AS yi, regexp_matches(p, '^y[uv](|an|e|n)$') AS yu, regexp_matches(p, '^[jqx]u') AS ju FROM r),
k AS (SELECT p_partkey, y || tone AS syllable, tone, r, p, v, CASE WHEN hiss OR hush THEN a WHEN ia OR yi OR (yu AND (v = 'eval' OR p <> 'yue')) OR p LIKE 'w%' THEN '' WHEN ju THEN left(p, 1) ELSE a END AS initial,
  CASE WHEN hiss THEN 'ii' WHEN hush THEN 'iii' WHEN ia THEN 'i' || substr(p, 2) WHEN yi THEN substr(p, 2) WHEN yu AND (v = 'eval' OR p <> 'yue') THEN 'v' || substr(p, 3) WHEN p = 'wu' THEN 'u' WHEN p LIKE 'w%' THEN 'u' || substr(p, 2)
    WHEN ju THEN 'v' || substr(p, 3) WHEN b = 'ui' THEN 'uei' WHEN b = 'iu' THEN 'iou' WHEN b = 'un' THEN 'uen' WHEN b = 'ue' THEN 've' ELSE b END AS final FROM x, (SELECT unnest(['eval', 'train']) AS v))
SELECT p_partkey, syllable, v AS variant, CASE WHEN final = '' THEN '' ELSE initial END AS initial, CASE WHEN final <> '' OR (p = '' AND r <> '' AND v = 'train') THEN final || r || tone ELSE '' END AS final FROM k""")
def pinyin_parts(t):
    at = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c + 1).cast("int"))
    k = F.col("p_partkey")
    y = F.concat(at(_INITIALS, k % len(_INITIALS)), at(_FINALS, F.floor(k / len(_INITIALS)) % len(_FINALS)), (k % 5 + 1).cast("string"))
    each = t("part").select("p_partkey", y.alias("syllable"), F.explode(F.array(F.lit("eval"), F.lit("train"))).alias("variant"))
    split = F.when(F.col("variant") == "eval", phonemes.split_pinyin(F.col("syllable"))).otherwise(phonemes.split_pinyin(F.col("syllable"), "train"))
    return each.withColumn("s", split).select("p_partkey", "syllable", "variant", "s.initial", "s.final")


_PIECES = f"""w AS (SELECT translate(unnest(string_split(lower(p_name), ' ')), '{_LETTERS}', '{_SIGNS}') AS w FROM part),
g AS (SELECT DISTINCT w, i, k FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= length(w)),
c AS (SELECT w, count(*) AS n FROM w GROUP BY 1), l0 AS (SELECT substr(g.w, i, k) AS word, sum(n) AS weight FROM g JOIN c ON g.w = c.w GROUP BY 1),
l AS (SELECT word, CAST(round(ln(weight / t.t) * 1000000) AS BIGINT) AS score FROM l0, (SELECT CAST(sum(weight) AS DOUBLE) AS t FROM l0) t), u AS (SELECT CAST(round(ln(1 / CAST(sum(weight) AS DOUBLE)) * 1000000) AS BIGINT) AS unknown FROM l0)"""


def _lexicon(t):
    """Pieces of up to four characters of the parts' names; a character's tone is its place in the piece."""
    words = t("part").select(F.explode(F.split(F.translate(F.lower("p_name"), _LETTERS, _SIGNS), " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pieces = words.select("n", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length("w") - i + 1)), lambda k: F.struct(i.alias("i"), F.substring(F.col("w"), i, k).alias("word")))))).alias("p"))
    lexicon = pieces.groupBy("p.word").agg(F.sum("n").alias("weight"))
    readings = F.transform(F.split("word", ""), lambda c, i: F.concat(F.translate(c, _SIGNS, _LETTERS), (i % 4 + 1).cast("string")))
    return lexicon.withColumn("readings", readings)


@query(f"""WITH RECURSIVE {_PIECES},
r AS (SELECT DISTINCT unnest(regexp_extract_all(translate(lower(text), '{_LETTERS}', '{_SIGNS}'), '[\\x{{4e00}}-\\x{{9fff}}]+')) AS run FROM documents),
b AS (SELECT run, CAST(length(run) AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS s, [''] AS p FROM r
  UNION ALL SELECT run, i - 1, list_prepend(best, s)[1:4], list_prepend(CASE WHEN c4 = best THEN substr(run, i, 4) || ' ' || p[4] WHEN c3 = best THEN substr(run, i, 3) || ' ' || p[3] WHEN c2 = best THEN substr(run, i, 2) || ' ' || p[2] ELSE substr(run, i, 1) || ' ' || p[1] END, p)[1:4]
  FROM (SELECT *, greatest(c1, c2, c3, c4) AS best FROM (SELECT b.run, b.i, b.s, b.p, coalesce(l1.score, unknown) + s[1] AS c1, l2.score + s[2] AS c2, l3.score + s[3] AS c3, l4.score + s[4] AS c4 FROM b CROSS JOIN u
    LEFT JOIN l l1 ON l1.word = substr(run, i, 1) LEFT JOIN l l2 ON l2.word = substr(run, i, 2) AND len(s) >= 2 LEFT JOIN l l3 ON l3.word = substr(run, i, 3) AND len(s) >= 3 LEFT JOIN l l4 ON l4.word = substr(run, i, 4) AND len(s) >= 4 WHERE b.i > 0)))
SELECT run, trim(p[1]) AS words, array_to_string(list_transform(string_split(trim(p[1]), ' '), lambda x: CASE WHEN length(x) = 1 AND NOT list_contains(single, x) THEN '?' ELSE array_to_string(list_transform(string_split(x, ''), lambda y, j: translate(y, '{_SIGNS}', '{_LETTERS}') || ((j - 1) % 4 + 1)), '') END), ' ') AS readings FROM b, (SELECT list(word) AS single FROM l WHERE length(word) = 1) WHERE i = 0""")
def chinese_words(t):
    runs = t("documents").select(F.explode(F.regexp_extract_all(F.translate(F.lower("text"), _LETTERS, _SIGNS), F.lit("([一-鿿]+)"), F.lit(1))).alias("run"))
    cut = chinese.cut_runs(runs, _lexicon(t))
    said = F.transform("readings", lambda w: F.array_join(F.transform(w, lambda x: F.coalesce(x, F.lit("?"))), ""))
    return cut.select("run", F.array_join("words", " ").alias("words"), F.array_join(said, " ").alias("readings"))


#: What the made-up lexicon says of a spelling: two letters for one sound, a silent end, one letter for two sounds.
_SOUNDS = [("th", "Θ "), ("sh", "Š "), ("ng", "Ŋ "), ("ou", "Ō "), ("x", "K Z "), ("e$", "")]


def _sounds_sql(c: str) -> str:
    for a, b in _SOUNDS:
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return f"trim(regexp_replace({c}, '([a-z])', '\\1 ', 'g'))"


def _sounds(c):
    for a, b in _SOUNDS:
        c = F.regexp_replace(c, a, b)
    return F.trim(F.regexp_replace(c, "([a-z])", "$1 "))


_HELD_OUT = "substr(md5(word), 1, 1) IN ('0', '1', '2')"


@query(f"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]+'))) AS word FROM benchmark) SELECT word, {_sounds_sql('word')} AS phones FROM w WHERE {_HELD_OUT}""")
def learned_phones(t):
    words = t("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), F.lit(1))).alias("word")).select(F.lower("word").alias("word")).distinct()
    lexicon = words.where(f"NOT {_HELD_OUT}").select("word", F.filter(F.split(_sounds(F.col("word")), " "), lambda x: x != "").alias("phones"))
    return g2p.convert_words(words.where(_HELD_OUT), g2p.fit(lexicon)).select("word", F.array_join("phones", " ").alias("phones"))


def _spoken_lexicon(t):
    """Words of the benchmark texts that hold `er`, said backwards, a symbol for each letter."""
    words = t("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), F.lit(1))).alias("word")).select(F.lower("word").alias("word")).distinct().where("contains(word, 'er')")
    return words.select("word", F.reverse(F.split(F.upper("word"), "")).alias("phones"))


_KNOWN = "n AS (SELECT list(DISTINCT w) AS known FROM (SELECT lower(unnest(regexp_extract_all(text, '[a-zA-Z]+'))) AS w FROM benchmark) WHERE contains(w, 'er'))"
_SAID = "CASE WHEN list_contains(known, lower(x)) THEN upper(reverse(x)) ELSE upper(x) END"
_HA_TE = "replace(replace(replace(replace(x, '哈特', '1'), '哈', '2'), '特', '3'), '1', 'h a t e sp ')"


def _two_signs(t):
    rows = [("哈特", 50.0, ["ha1", "te4"]), ("哈", 5.0, ["ha1"]), ("特", 5.0, ["te4"])]
    return t("region").sparkSession.createDataFrame(rows, "word string, weight double, readings array<string>")


@query(f"""WITH {_KNOWN}, w AS (SELECT conv_id, turn, regexp_extract_all(translate(regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g'), 'ht', '哈特'), '[\\x{{4e00}}-\\x{{9fff}}]+|[a-zA-Z]+') AS w FROM conversations WHERE turn > 0 AND role <> 'assistant')
SELECT conv_id, turn, trim(array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z]') THEN trim(regexp_replace({_SAID}, '(.)', '\\1 ', 'g')) || ' sp' ELSE trim(replace(replace({_HA_TE}, '2', 'h a sp '), '3', 't e sp ')) END), ' ')) AS phonemes FROM w, n""")
def conversation_phonemes(t):
    from strophe.plans.composites import conversation_phonemes as spoken

    bare = F.translate(F.regexp_replace(F.regexp_replace("text", r"[^\x00-\x7f]", " "), r"[\[\]\n]", " "), "ht", "哈特")
    c = t("conversations").withColumn("text", F.concat(F.lit("[lyrics:"), F.regexp_replace(bare, "[0-9]", " "), F.lit("]")))
    return spoken(c, "conv_id", _spoken_lexicon(t), chinese=_two_signs(t), variant="train")


@query(f"""WITH {_KNOWN}, p AS (SELECT a.conv_id * 1000 + a.turn AS file_index, regexp_replace(regexp_replace(a.text, '[ ,。"，:;&—''.\\]\\[()?\\n-]', ' ', 'g'), ' {{2,}}', ' ', 'g') AS r, regexp_replace(regexp_replace(b.text, '[ ,。"，:;&—''.\\]\\[()?\\n-]', ' ', 'g'), ' {{2,}}', ' ', 'g') AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
c AS (SELECT file_index, left(r, least(length(r), length(h))) AS r, left(h, least(length(r), length(h))) AS h FROM p),
w AS (SELECT file_index, array_to_string(list_transform(regexp_extract_all(r, '[a-zA-Z]+'), lambda x: {_SAID}), '') AS r, array_to_string(list_transform(regexp_extract_all(h, '[a-zA-Z]+'), lambda x: {_SAID}), '') AS h FROM c, n)
SELECT file_index, round(CASE WHEN length(r) = 0 THEN (CASE WHEN length(h) > 0 THEN 1.0 ELSE 0.0 END) ELSE levenshtein(r, h) / length(r) END, 6) AS per FROM w""")
def per_evaluation(t):
    from strophe.plans.composites import per_evaluation as evaluate
    from strophe.plans.registry import r6

    c = t("conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    hyp = c.select((F.col("k") - 1).alias("file_idx"), F.lit("x").alias("file_name"), F.col("text").alias("hyp_text"))
    return evaluate(hyp, c.select(F.col("k").alias("file_index"), F.col("text").alias("lyrics")), _spoken_lexicon(t)).select("file_index", r6("per").alias("per"))


_WORDS = ", ".join(f"'{w}'" for w in phonemes.DIGITS)


@query(f"""WITH r AS (SELECT item_id, regexp_extract_all(translate(regexp_replace(text, 'e', '7', 'g'), 'ht', '哈特'), '[\\x{{4e00}}-\\x{{9fff}}]+|[a-zA-Z]+|[0-9]+') AS w FROM benchmark),
u AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM r), v AS (SELECT *, CASE WHEN regexp_matches(word, '^[a-zA-Z]') THEN 1 ELSE 0 END AS english, regexp_matches(word, '^[0-9]') AS digit FROM u),
x AS (SELECT *, sum(english) OVER (PARTITION BY item_id ORDER BY i) AS before FROM v),
k AS (SELECT item_id, i, CASE WHEN digit THEN [{_WORDS}][CAST(left(word, 1) AS INT) + 1] ELSE word END AS word, CASE WHEN digit THEN 1 ELSE english END AS tag FROM x WHERE NOT digit OR before >= 4)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS pos, word, tag FROM k""")
def language_runs(t):
    runs = phonemes.language_runs(F.translate(F.regexp_replace("text", "e", "7"), "ht", "哈特"))
    return t("benchmark").select("item_id", F.posexplode(runs).alias("pos", "r")).select("item_id", F.col("pos").cast("long").alias("pos"), F.col("r.text").alias("word"), F.col("r.tag").alias("tag"))
