"""Visibility queries on answers derived from documents: ``[j]`` follows sentence k of document d, j = (7 d + 3 k) mod 6, where 5 is no document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators.sentences import train, with_sentences
from ..operators.visibility import best_worst, mean_scores, target_score, with_impressions
from .registry import load, query

N = 5


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", sentences(F.col("text")).alias("s"))
    cited = F.transform("s", lambda s, k: F.concat(s, F.lit("["), ((F.col("doc_id") * 7 + k * 3) % 6).cast("string"), F.lit("]")))
    return docs.select("doc_id", "source", F.array_join(cited, "\n\n").alias("text"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_impressions(cited_answers(spark, sf_dir), n=N).select("doc_id", "source", "scores")


_CTE = r"""
WITH s0 AS (
  SELECT doc_id, source, list_filter(flatten(list_transform(string_split(text, chr(10) || chr(10)),
    lambda p: string_split(regexp_replace(p, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)))), lambda x: trim(x) <> '') AS l
  FROM documents
), s1 AS (
  SELECT doc_id, source, len(l) AS size, unnest(l) AS s, unnest(range(0, len(l))) AS i FROM s0
), s2 AS (
  SELECT doc_id, source, size, i, CAST((doc_id * 7 + i * 3) % 6 AS INTEGER) AS slot,
         len(list_filter(regexp_extract_all(s, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]'), lambda w: length(w) > 2)) AS words,
         CASE WHEN size > 1 THEN exp(-i / CAST(size - 1 AS DOUBLE)) ELSE 1.0 END AS decay
  FROM s1
), g AS (
  SELECT doc_id, slot, sum(words * decay) AS wordpos, CAST(sum(words) AS DOUBLE) AS word, sum(decay) AS pos FROM s2 WHERE slot < 5 GROUP BY 1, 2
), e AS (
  SELECT d.doc_id, d.source, CAST(k.slot AS INTEGER) AS slot, coalesce(wordpos, 0) AS wordpos, coalesce(word, 0) AS word, coalesce(pos, 0) AS pos
  FROM documents d CROSS JOIN (SELECT unnest(range(0, 5)) AS slot) k LEFT JOIN g ON g.doc_id = d.doc_id AND g.slot = k.slot
), f AS (
  SELECT doc_id, source, slot,
         CASE WHEN sum(wordpos) OVER w > 0 THEN wordpos / sum(wordpos) OVER w ELSE 0.2 END AS wordpos,
         CASE WHEN sum(word) OVER w > 0 THEN word / sum(word) OVER w ELSE 0.2 END AS word,
         CASE WHEN sum(pos) OVER w > 0 THEN pos / sum(pos) OVER w ELSE 0.2 END AS pos
  FROM e WINDOW w AS (PARTITION BY doc_id)
)
"""


def _kind(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scored(spark, sf_dir).select("doc_id", F.explode_outer("scores").alias("s"))
        return rows.select("doc_id", "s.slot", F.round(f"s.{kind}", 6).alias("score"))

    return run


for _kind_name in ("wordpos", "word", "pos"):
    query(f"geo_{_kind_name}", _CTE + f"SELECT doc_id, slot, round({_kind_name}, 6) AS score FROM f")(_kind(_kind_name))


@query("geo_impressions", _CTE + "SELECT doc_id, slot, round(wordpos, 6) AS wordpos, round(word, 6) AS word, round(pos, 6) AS pos FROM f")
def geo_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("doc_id", F.explode_outer("scores").alias("s"))
    return rows.select("doc_id", "s.slot", *(F.round(f"s.{k}", 6).alias(k) for k in ("wordpos", "word", "pos")))


@query("geo_mean_by_source", _CTE + "SELECT source, round(avg(wordpos), 6) AS wordpos, round(avg(word), 6) AS word, round(avg(pos), 6) AS pos FROM f WHERE slot = doc_id % 5 GROUP BY source")
def geo_mean_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("source", target_score(F.col("scores"), (F.col("doc_id") % N).cast("int")).alias("s")).select("source", "s.*")
    means = mean_scores(rows, ["source"], ["wordpos", "word", "pos"])
    return means.select("source", *(F.round(k, 6).alias(k) for k in ("wordpos", "word", "pos")))


@query(
    "best_worst_doc",
    _CTE + ", t AS (SELECT doc_id, slot, round(wordpos + word + pos, 9) AS x FROM f) "
    "SELECT doc_id, arg_min(slot, (-x, slot)) AS best, arg_min(slot, (x, slot)) AS worst FROM t GROUP BY doc_id",
)
def best_worst_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", best_worst(F.col("scores")).alias("b")).select("doc_id", F.col("b.best").cast("int").alias("best"), F.col("b.worst").cast("int").alias("worst"))


_WS = r"[ \t\n\x0B\f\r]"


def _ll(k: str, n: str, p: str) -> str:
    of = lambda c, q: f"CASE WHEN {c} > 0 THEN {c} * ln(greatest({q}, 1e-300)) ELSE 0.0 END"
    return f"({of(k, p)} + {of(f'({n} - {k})', f'(1 - {p})')})"


def _ratio(a: str, b: str, both: str, n: str) -> str:
    p, p1 = f"({b} / CAST({n} AS DOUBLE))", f"({both} / CAST({a} AS DOUBLE))"
    p2 = f"CASE WHEN {n} = {a} THEN 0.0 ELSE ({b} - {both}) / CAST({n} - {a} AS DOUBLE) END"
    rest, others = f"({b} - {both})", f"({n} - {a})"
    return f"CASE WHEN {p1} > {p} THEN -2 * ({_ll(both, a, p)} + {_ll(rest, others, p)} - {_ll(both, a, p1)} - {_ll(rest, others, p2)}) ELSE 0.0 END"


#: From texts(doc_id, text) to split(doc_id, i, s): the model and the splitter as SQL.
_LEARNT = rf"""
chunked AS (SELECT doc_id, unnest(l) AS chunk, unnest(range(0, len(l))) AS i, len(l) AS n_chunks FROM (SELECT doc_id, regexp_extract_all(text, '^{_WS}+|[^ \t\n\x0B\f\r]+{_WS}*') AS l FROM texts WHERE text IS NOT NULL)),
cored AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(chunk, '{_WS}+$', ''), '^["''“‘«„(\[{{]+', ''), '(?:\[[^\w\s]*\d+[^\w\s]*\]|["''”’»)\]}}])+$', '') AS core FROM chunked),
based AS (SELECT *, lower(regexp_replace(core, '[.,;:!?…]+$', '')) AS raw, CASE WHEN regexp_matches(core, '[!?]$') THEN '!' WHEN regexp_matches(core, '(\.\.|…)$') THEN '…' WHEN core LIKE '%.' THEN '.' ELSE '' END AS mark,
  regexp_matches(chunk, '\n[ \t\x0B\f\r]*\n') AS ends, CASE WHEN regexp_matches(core, '^\p{{Lu}}') THEN 'U' WHEN regexp_matches(core, '^\p{{Ll}}') THEN 'l' ELSE '-' END AS kind FROM cored),
tok AS (SELECT doc_id, i, n_chunks, chunk, CASE WHEN regexp_full_match(raw, '[+-]?\d[\d.,:/-]*') THEN '##' ELSE raw END AS base, mark, ends, kind FROM based),
types AS (SELECT base, count(*) AS n, count(*) FILTER (mark = '.') AS dotted FROM tok WHERE base <> '' GROUP BY base),
total AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, coalesce(sum(dotted), 0) / CAST(greatest(coalesce(sum(n), 0), 1) AS DOUBLE) AS share FROM types),
short AS (SELECT base AS before FROM (SELECT *, length(base) - length(replace(base, '.', '')) AS inn FROM types, total)
  WHERE dotted > 0 AND regexp_matches(base, '\p{{L}}') AND -2 * ({_ll('dotted', 'n', 'share')} - {_ll('dotted', 'n', '0.99')}) * exp(-(length(base) - inn)) * (inn + 1) * pow(CAST(length(base) - inn AS DOUBLE), -CAST(n - dotted AS DOUBLE)) >= 0.3),
nexts AS (SELECT doc_id, i, base AS after, kind, lag(base) OVER w AS a_base, coalesce(lag(mark) OVER w, '!') AS a_mark, coalesce(lag(ends) OVER w, true) AS a_ends FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
pairs0 AS (SELECT CASE WHEN a_mark IN ('.', '…') AND NOT a_ends THEN CASE WHEN a_mark = '…' THEN '…' ELSE a_base END END AS before, a_ends OR a_mark = '!' AS sure, after, kind, count(*) AS k FROM nexts GROUP BY ALL),
pairs AS (SELECT p.before, p.after, p.kind, p.k, coalesce(s.before IS NOT NULL OR p.before = '…', false) AS abbr, coalesce(regexp_full_match(p.before, '\p{{L}}') OR p.before = '##', false) AS odd, sure FROM pairs0 p LEFT JOIN short s ON s.before = p.before),
ended AS (SELECT *, CASE WHEN before IS NULL THEN sure ELSE NOT abbr AND NOT odd END AS ending FROM pairs),
words AS (SELECT after, sum(CASE WHEN kind = 'U' THEN k ELSE 0 END) AS upper_, sum(CASE WHEN kind = 'U' AND NOT ending THEN k ELSE 0 END) AS inside, sum(CASE WHEN kind = 'l' THEN k ELSE 0 END) AS lower_, sum(CASE WHEN kind = 'l' AND ending THEN k ELSE 0 END) AS begin_lower,
  CAST(sum(CASE WHEN ending AND before IS NOT NULL THEN k ELSE 0 END) AS BIGINT) AS started FROM ended WHERE after <> '' GROUP BY after),
ends AS (SELECT greatest(CAST(coalesce(sum(CASE WHEN ending AND before IS NOT NULL AND after <> '' THEN k ELSE 0 END), 0) AS BIGINT), 1) AS n_ends FROM ended),
rated AS (SELECT w.*, regexp_matches(after, '^\p{{L}}') AND started > 0 AND {_ratio('n_ends', 't.n', 'started', 'total')} >= 30.0 AS starter FROM words w JOIN types t ON t.base = w.after, ends, total),
held AS (SELECT * FROM ended WHERE before IS NOT NULL AND (abbr OR odd)),
both_ AS (SELECT before, after, CAST(sum(k) AS BIGINT) AS c FROM held GROUP BY before, after),
paired AS (SELECT b.before, b.after FROM both_ b JOIN types x ON x.base = b.before JOIN types y ON y.base = b.after, total WHERE c > 1 AND {_ratio('x.dotted', 'y.n', 'c', 'total')} >= 7.88),
judged AS (SELECT h.before, h.after, h.kind, h.odd, h.abbr, q.before IS NOT NULL AS pair, coalesce(r.lower_, 0) AS lo, h.kind = 'U' AND coalesce(r.lower_, 0) > 0 AND coalesce(r.inside, 0) = 0 AS breaks, h.kind = 'l' AND (coalesce(r.upper_, 0) > 0 OR coalesce(r.begin_lower, 0) = 0) AS joins, coalesce(r.starter, false) AS starter
  FROM held h LEFT JOIN rated r ON r.after = h.after LEFT JOIN paired q ON q.before = h.before AND q.after = h.after),
joined AS (SELECT DISTINCT before, after, kind FROM judged WHERE CASE WHEN odd THEN pair OR joins OR regexp_full_match(before, '\p{{L}}') AND kind = 'U' AND NOT breaks AND lo = 0 OR abbr AND NOT (breaks OR kind = 'U' AND starter) ELSE NOT (breaks OR kind = 'U' AND starter) END),
ahead AS (SELECT *, lead(base) OVER w AS after, lead(kind) OVER w AS after_kind FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
stops AS (SELECT a.doc_id, a.i, a.chunk, a.i = a.n_chunks - 1 OR a.ends OR a.mark = '!' OR a.mark IN ('.', '…') AND j.before IS NULL AS stop FROM ahead a LEFT JOIN joined j ON j.before = CASE WHEN a.mark = '.' THEN a.base ELSE '…' END AND j.after = a.after AND j.kind = a.after_kind AND a.mark IN ('.', '…') AND NOT a.ends),
counted AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - CASE WHEN stop THEN 1 ELSE 0 END AS sentence FROM stops),
whole AS (SELECT doc_id, sentence, regexp_replace(string_agg(chunk, '' ORDER BY i), '^{_WS}+|{_WS}+$', '', 'g') AS s FROM counted GROUP BY doc_id, sentence),
split AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS size, s FROM whole WHERE s <> '')
"""


@query(
    "learnt_sentences",
    "WITH texts AS (SELECT doc_id, text FROM documents)," + _LEARNT + """
    SELECT d.doc_id, CAST(count(s) AS INTEGER) AS n_sentences, CAST(max(length(s)) AS INTEGER) AS longest, md5(coalesce(string_agg(s, chr(10) ORDER BY i), '')) AS digest FROM documents d LEFT JOIN split USING (doc_id) GROUP BY d.doc_id""",
)
def learnt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document by the model learnt from all of them: their number, and the longest one's length."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    split = with_sentences(docs, train(docs))
    longest = F.array_max(F.transform("sentences", lambda s: F.length(s)))
    return split.select("doc_id", F.size("sentences").alias("n_sentences"), longest.alias("longest"), F.md5(F.array_join("sentences", "\n")).alias("digest"))


@query(
    "learnt_impressions",
    r"""WITH ruled AS (SELECT doc_id, list_filter(flatten(list_transform(string_split(text, chr(10) || chr(10)), lambda p: string_split(regexp_replace(p, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)))), lambda x: trim(x) <> '') AS l FROM documents),
    texts AS (SELECT doc_id, array_to_string(list_transform(l, lambda x, k: x || '[' || CAST((doc_id * 7 + (k - 1) * 3) % 6 AS INTEGER) || ']'), ' ') AS text FROM ruled),"""
    + _LEARNT
    + r""",
    cited AS (SELECT doc_id, i, size, len(list_filter(regexp_extract_all(s, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]'), lambda w: length(w) > 2)) AS words, list_transform(regexp_extract_all(s, '\[[^\w\s]*\d+[^\w\s]*\]'), lambda c: CAST(regexp_extract(c, '\d+') AS INTEGER)) AS c FROM split),
    each AS (SELECT doc_id, unnest(c) AS slot, words / CAST(len(c) AS DOUBLE) AS w, CASE WHEN size > 1 THEN exp(-i / CAST(size - 1 AS DOUBLE)) ELSE 1.0 END AS decay, len(c) AS k FROM cited WHERE len(c) > 0),
    g AS (SELECT doc_id, slot, sum(w * decay) AS wordpos, sum(w) AS word, sum(decay / k) AS pos FROM each WHERE slot < 5 GROUP BY 1, 2),
    e AS (SELECT d.doc_id, CAST(z.slot AS INTEGER) AS slot, coalesce(wordpos, 0) AS wordpos, coalesce(word, 0) AS word, coalesce(pos, 0) AS pos FROM documents d CROSS JOIN (SELECT unnest(range(0, 5)) AS slot) z LEFT JOIN g ON g.doc_id = d.doc_id AND g.slot = z.slot)
    SELECT doc_id, slot, round(CASE WHEN sum(wordpos) OVER w > 0 THEN wordpos / sum(wordpos) OVER w ELSE 0.2 END, 6) AS wordpos, round(CASE WHEN sum(word) OVER w > 0 THEN word / sum(word) OVER w ELSE 0.2 END, 6) AS word, round(CASE WHEN sum(pos) OVER w > 0 THEN pos / sum(pos) OVER w ELSE 0.2 END, 6) AS pos FROM e WINDOW w AS (PARTITION BY doc_id)""",
)
def learnt_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions of answers that cite a slot after each sentence of a document, split by the model learnt from the answers."""
    docs = load(spark, sf_dir, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    cited = F.transform("s", lambda s, k: F.concat(s, F.lit("["), ((F.col("doc_id") * 7 + k * 3) % 6).cast("string"), F.lit("]")))
    answers = docs.select("doc_id", F.array_join(cited, " ").alias("text"))
    rows = with_impressions(with_sentences(answers, train(answers)), n=N, split="sentences").select("doc_id", F.explode_outer("scores").alias("s"))
    return rows.select("doc_id", "s.slot", *(F.round(f"s.{k}", 6).alias(k) for k in ("wordpos", "word", "pos")))
