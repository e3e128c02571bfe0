"""Scalar functions, prompts and single-row reshaping, on every row of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.code import fix_cpp
from ..operators import alignment as A
from ..operators import packing as G
from ..operators import rewards as R
from ..operators import rules as U
from ..operators import scorer as C
from ..operators import templates as T
from ..operators import tools as O
from ..operators import visibility as V
from .registry import load, query


def _docs(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", *columns)


def _words() -> Column:
    """Ids made of a row's values: the lengths of its text's words."""
    return F.transform(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^ \t\n\f\r]+"), F.lit(0)), lambda w: F.length(w))


def _letters(column: str = "source") -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit("."), F.lit(0)), lambda x: F.ascii(x))


_ARRAYS = r"""WITH d AS (SELECT *, CAST(list_transform(regexp_extract_all(coalesce(text, ''), '[^ \t\n\f\r]+'), lambda x: length(x)) AS INTEGER[]) AS w,
    CAST(list_transform(regexp_extract_all(coalesce(source, ''), '.'), lambda x: ascii(x)) AS INTEGER[]) AS s, CAST(list_transform(regexp_extract_all(coalesce(lang, ''), '.'), lambda x: ascii(x)) AS INTEGER[]) AS l FROM documents)
"""


def _target(source: str, target: str, cutoff: str) -> str:
    """How much of a response is kept."""
    return f"CAST(CASE WHEN {target} * 2 < {cutoff} THEN least({cutoff}, {target}) WHEN {source} * 2 < {cutoff} THEN least({cutoff} - {source}, {target}) ELSE least(floor({cutoff} * ({target} / CAST({source} + {target} AS DOUBLE))), {target}) END AS INTEGER)"


def _source(source: str, kept: str, cutoff: str) -> str:
    """How much of a prompt is kept."""
    return f"CAST(least(greatest({cutoff} - {kept}, 0), {source}) AS INTEGER)"


def _text(ids: str) -> str:
    return f"coalesce(array_to_string({ids}, ','), '')"


def _joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


@query(
    "source_block_cited",
    "SELECT doc_id, '### Source 0:' || chr(10) || coalesce(lang, '') || chr(10) || chr(10) || '### Source 1:' || chr(10) || 'about ' || doc_id AS block, 1 AS best, 1.0 AS word FROM documents",
)
def source_block_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer that cites the number under which the prompt shows a document gives this document all."""
    own = F.concat(F.lit("about "), F.col("doc_id").cast("string"))
    rows = _docs(spark, sf_dir, V.source_block(F.array("lang", own)).alias("block"))
    number = F.regexp_extract(F.col("block"), r"(\d+):\nabout ", 1)
    rows = rows.withColumn("answer", F.concat(F.lit("Several words say this ["), number, F.lit("].")))
    scored = V.with_impressions(rows, "answer", n=2)
    return scored.select("doc_id", "block", V.best_worst(F.col("scores"))["best"].cast("int").alias("best"), F.get("scores", F.lit(1))["word"].alias("word"))


@query("splice_texts", """WITH d AS (SELECT doc_id, source, n_chars % 4 AS t, string_split(coalesce(text, ''), chr(10) || chr(10)) AS p FROM documents)
    SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i - 1 = t THEN source ELSE x END), '|') AS texts FROM d""")
def splice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of which one is replaced; where the place is none of theirs, none."""
    texts = F.split(F.coalesce("text", F.lit("")), "\n\n")
    return _docs(spark, sf_dir, F.array_join(V.splice(texts, (F.col("n_chars") % 4).cast("int"), F.col("source")), "|").alias("texts"))


@query("without_headers", "SELECT doc_id, text, text IS NOT NULL AND text <> '' AS present FROM documents")
def without_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = F.concat(F.get(F.array(F.lit("**Rewritten Source: **"), F.lit("**Regenerated Source: **"), F.lit("")), (F.col("doc_id") % 3).cast("int")), "text")
    return _docs(spark, sf_dir, X.without_headers(headed).alias("text"), X.present(F.col("text")).alias("present"))


@query("hashed_ids", "SELECT doc_id, md5(source || '/' || n_chars) AS hashed FROM documents")
def hashed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.preparation import hashed_id

    return _docs(spark, sf_dir, hashed_id(F.concat("source", F.lit("/"), F.col("n_chars").cast("string"))).alias("hashed"))


@query("thoughts", "SELECT doc_id, length(text) AS bare, length(text) + 19 AS added FROM documents")
def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace("text", r"^\n+", "")
    thought = X.remove_thought(F.concat(F.lit("<think>x\ny</think>\n\n"), "text"))
    same = (thought == t).cast("long") * F.length("text")
    return _docs(spark, sf_dir, F.when(F.col("text").startswith("\n"), F.length("text").cast("long")).otherwise(same).alias("bare"), F.length(X.add_thought(F.col("text"))).cast("long").alias("added"))


@query("token_estimate", "SELECT doc_id, CAST(floor((length(text) + length(source)) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, X.estimated_tokens(F.array("text", "source")).alias("tokens"))


@query("json_lists", "SELECT doc_id, '[\"' || source || '\", \" \", \"b\"]' AS part, source || ',b' AS rules FROM documents")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON list between other words; where it cannot be parsed its quoted strings."""
    whole = F.concat(F.lit("```json\n[\""), "source", F.lit('", " ", "b"]\n``` ok'))
    broken = F.concat(F.lit('Rules: "'), "source", F.lit('" and "b" and " "'))
    text = F.when(F.col("doc_id") % 2 == 0, whole).otherwise(broken)
    return _docs(spark, sf_dir, X.json_between(whole).alias("part"), _joined(X.parse_rule_list(text)).alias("rules"))


@query(
    "verdicts",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'AC' WHEN quality IS NULL THEN 'PA' WHEN toxic = 1 THEN 'TLE' WHEN n_chars % 4 = 0 THEN 'CE' WHEN n_chars % 4 = 1 THEN 'MLE' WHEN n_chars % 4 = 2 THEN 'WA' ELSE 'RE' END AS verdict
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as scores; feedback that begins with a whole text and ends with a judge's words, or with words that are none."""
    rows = _docs(spark, sf_dir, "text", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    ends = F.array(*map(F.lit, (" Compilation error ", "Memory limit exceeded", "Output isn't correct", "Could not compile")))
    said = F.concat("text", F.when(F.col("toxic") == 1, " Time limit exceeded. ").otherwise(F.get(ends, (F.col("n_chars") % 4).cast("int"))))
    return rows.select("doc_id", X.verdict(F.coalesce(F.col("quality").cast("double"), F.lit(0.5)), said).alias("verdict"))


@query("method_names", "SELECT doc_id, 'autogeo' AS method, 'researchy-geo' AS dataset, lower(source) AS engine FROM documents")
def method_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = X.method_name(F.lit("AutoGEO"), F.lit("Researchy-GEO"), F.regexp_replace("source", "_", "-"))
    return _docs(spark, sf_dir, X.parse_method_name(name, ["auto", "autogeo"]).alias("m")).select("doc_id", "m.method", "m.dataset", "m.engine")


@query("question_ids", "SELECT doc_id, lang || '-' || n_chars AS question FROM documents")
def question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("n_chars") % 2 == 0, "_aggregated.json").otherwise(".json")
    path = F.concat(F.lit("file:///data/x.y/"), "source", F.lit("/"), "lang", F.lit("-"), F.col("n_chars").cast("string"), end)
    return _docs(spark, sf_dir, X.question_id(path).alias("question"))


@query("trimmed_padding", _ARRAYS + "SELECT doc_id, CASE WHEN len(w) = 0 THEN '0' ELSE array_to_string(w, ',') END AS lefts, CASE WHEN len(w) = 0 THEN '0' ELSE array_to_string(w, ',') || ',0' END AS rights FROM d")
def trimmed_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths between as many zeros as the source has letters."""
    pad = F.transform(_letters(), lambda c: F.lit(0))
    left, right = X.trim_padding(F.concat(pad, _words()), 0), X.trim_padding(F.concat(_words(), pad), 0, "right", eos=0)
    return _docs(spark, sf_dir, _joined(left).alias("lefts"), _joined(right).alias("rights"))


@query("include_headers", "SELECT doc_id, '#include <bits/stdc++.h>' || chr(10) || '#include \"' || source || '.h\"' || chr(10) || chr(10) || 'using namespace std;' || chr(10) || chr(10) || 'int f();' AS code FROM documents")
def include_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, fix_cpp(F.lit("int f();"), F.col("source")).alias("code"))


@query("chat_prompts", "SELECT doc_id, 'system:Be kind.|user:' || source AS turns FROM documents")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.chat_prompt(_docs(spark, sf_dir, "source"), "source", "Be kind.")
    return rows.select("doc_id", F.array_join(F.transform("prompt", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|").alias("turns"))


@query("media_marks", "SELECT doc_id, replace(coalesce(text, ''), chr(10), repeat('<image>', length(coalesce(source, '')))) AS text, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INTEGER) AS marks FROM documents")
def media_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a mark for each line end and as many images pass the check, and each mark becomes as many as there are tokens."""
    text = F.coalesce("text", F.lit(""))
    marked = F.replace(text, F.lit("\n"), F.lit("<image>"))
    images = F.array_repeat(F.lit("x"), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))
    rows = _docs(spark, sf_dir, "source", marked.alias("marked"), F.array(A.turn("user", marked)).alias("_prompt"), images.alias("_images"), F.lit(None).cast("array<string>").alias("_videos"), F.lit(None).cast("array<string>").alias("_audios"))
    rows = A.check_media(rows)
    return rows.select("doc_id", A.placeholders(F.col("marked"), "<image>", F.length(F.coalesce("source", F.lit("")))).alias("text"), F.size("_images").alias("marks"))


@query("alternating_turns", """WITH c AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, role, text) AS l FROM conversations GROUP BY conv_id)
    SELECT conv_id, coalesce(array_to_string(list_transform(l[1:len(l) - len(l) % 2], lambda x, i: CASE WHEN i % 2 = 1 THEN 'human:' ELSE 'gpt:' END || x), '|'), '') AS turns FROM c""")
def alternating_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of conversations as alternating turns."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("l")).withColumn("l", F.transform("l", lambda t: t["text"]))
    return rows.select("conv_id", F.array_join(F.transform(A.alternating(F.col("l")), lambda t: F.concat(t["from"], F.lit(":"), t["value"])), "|").alias("turns"))


@query("dialogue_turns", "SELECT doc_id, 'human:Who?|gpt:' || source || '|human:More|gpt:Yes' AS turns, 'More' AS instruction, 'Yes' AS answer, 'Who?|' || source AS history FROM documents")
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Human: Who?\nAssistant: "), "source", F.lit("\nHuman: More\nAssistant: Yes"))
    marked = F.concat(F.lit("\n\nHuman: Who?\n\nAssistant: "), "source", F.lit("\n\nHuman: More\n\nAssistant: Yes"))
    rows = _docs(spark, sf_dir, A.split_dialogue(text).alias("t"), A.last_exchange(marked).alias("x"))
    turns = F.array_join(F.transform("t", lambda t: F.concat(t["from"], F.lit(":"), t["value"])), "|")
    return rows.select("doc_id", turns.alias("turns"), "x.instruction", "x.answer", F.array_join(F.flatten("x.history"), "|").alias("history"))


@query(
    "few_shot_prompts",
    """WITH s AS (SELECT lang, question, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS k FROM (SELECT doc_id, coalesce(lang, '?') AS lang, 'q' || doc_id AS question FROM documents)),
    f AS (SELECT lang, max(question) FILTER (k = 1) AS q1, max(question) FILTER (k = 2) AS q2 FROM s GROUP BY lang)
    SELECT doc_id, 'user:The following are multiple choice questions (with answers) about ' || d.lang || '.' || chr(10) || chr(10) || q1 || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || 'Answer:|assistant:A|user:'
    || q2 || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || 'Answer:|assistant:A|user:q' || doc_id || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || 'Answer:|assistant:A' AS turns
    FROM (SELECT doc_id, coalesce(lang, '?') AS lang FROM documents) d JOIN f USING (lang)""",
)
def few_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, F.coalesce("lang", F.lit("?")).alias("lang"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), F.lit("x").alias("A"), F.lit("y").alias("B"), F.lit("A").alias("answer"))
    both = rows.join(A.support_draw(rows, "lang", "doc_id", 2), "lang")
    turns = A.few_shot(F.col("question"), {"A": F.col("A"), "B": F.col("B")}, F.col("answer"), F.col("support"), F.col("lang"))
    return both.select("doc_id", F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|").alias("turns"))


def _exchange(text: Column) -> Column:
    return F.array(A.turn("user", text), A.turn("assistant", F.lit("fine")))


@query("templates_rendered", "SELECT doc_id, '<|im_start|>system' || chr(10) || 'S<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || source || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || 'fine<|im_end|>' || chr(10) AS text, '<bos>[INST] S' || chr(10) || chr(10) || source || '[/INST] fine<eos>' AS fused FROM documents")
def templates_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name: F.array_join(T.render(T.TEMPLATES[name], _exchange(F.col("source")), F.lit("S")), "")
    return _docs(spark, sf_dir, one("chatml").alias("text"), one("mistral").alias("fused"))


@query("thinking_pairs", "SELECT doc_id, '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || text || '<|im_end|>' || chr(10) AS learnt, text || '<|im_end|>' || chr(10) AS plain FROM documents")
def thinking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that are whole texts, with and without an empty thought before them."""
    turns = F.array(A.turn("user", F.col("source")), A.turn("assistant", F.col("text")))
    one = lambda on: F.get(T.pairs(T.TEMPLATES["qwen3"], turns, thinking=on), F.lit(0))["response"]
    return _docs(spark, sf_dir, one(True).alias("learnt"), one(False).alias("plain"))


@query(
    "tool_prompts",
    rf"""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS s, n_chars AS n FROM documents),
    t AS (SELECT *, '{{"name": "' || s || '", "description": "of ' || n || '", "parameters": {{"type": "object", "properties": {{"a": {{"type": "string", "description": "x", "enum": ["' || s || '", "y"]}}, "b": {{"type": "array", "items": {{"type": "number"}}}}}}, "required": ["a"]}}}}' AS j,
      '{{' || chr(10) || '    "name": "' || s || '",' || chr(10) || '    "description": "of ' || n || '",' || chr(10) || '    "parameters": {{' || chr(10) || '        "type": "object",' || chr(10) || '        "properties": {{' || chr(10)
      || '            "a": {{' || chr(10) || '                "type": "string",' || chr(10) || '                "description": "x",' || chr(10) || '                "enum": [' || chr(10) || '                    "' || s || '",' || chr(10) || '                    "y"' || chr(10) || '                ]' || chr(10) || '            }},' || chr(10)
      || '            "b": {{' || chr(10) || '                "type": "array",' || chr(10) || '                "items": {{' || chr(10) || '                    "type": "number"' || chr(10) || '                }}' || chr(10) || '            }}' || chr(10) || '        }},' || chr(10)
      || '        "required": [' || chr(10) || '            "a"' || chr(10) || '        ]' || chr(10) || '    }}' || chr(10) || '}}' AS i FROM d)
    SELECT doc_id, '[AVAILABLE_TOOLS] [{{"type": "function", "function": ' || j || '}}][/AVAILABLE_TOOLS]' AS mistral,
    'You have access to the following tools:' || chr(10) || '> Tool Name: ' || s || chr(10) || 'Tool Description: of ' || n || chr(10) || 'Tool Args:' || chr(10) || '  - a (string, required): x, should be one of [' || s || ', y]' || chr(10) || '  - b (array): , where each item should be number' || chr(10) || chr(10)
    || 'Use the following format if using a tool:' || chr(10) || '```' || chr(10) || 'Action: tool name (one of [' || s || '])' || chr(10)
    || 'Action Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{{"input": "hello world", "num_beams": 5}}```)' || chr(10) || '```' || chr(10) AS default_,
    '{O.FRAMES["glm4"].format(tools="")}' || chr(10) || chr(10) || '## ' || s || chr(10) || chr(10) || i || chr(10) || '在调用上述函数时，请使用 Json 格式表示调用的参数。' AS glm4,
    '{O.FRAMES["llama3"].format(today="02 Mar 2024", tools="")}' || '{{' || chr(10) || '    "type": "function",' || chr(10) || '    "function": ' || replace(i, chr(10), chr(10) || '    ') || chr(10) || '}}' || chr(10) || chr(10) AS llama3,
    split_part('{O.FRAMES["qwen"].format(tools="@@")}', '@@', 1) || chr(10) || '{{"type": "function", "function": ' || j || '}}' || split_part('{O.FRAMES["qwen"].format(tools="@@")}', '@@', 2) AS qwen FROM t""",
)
def tool_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool made of a document's source and length, listed in five dialects; the frames are fixed texts."""
    made = '[{"name": "%s", "description": "of %d", "parameters": {"type": "object", "properties": {"a": {"type": "string", "description": "x", "enum": ["%s", "y"]}, "b": {"type": "array", "items": {"type": "number"}}}, "required": ["a"]}}]'
    name = F.coalesce("source", F.lit("none"))
    rows = _docs(spark, sf_dir, F.format_string(made, name, F.col("n_chars").cast("long"), name).alias("tools"))
    rows = T.with_tool_text(rows, T.TEMPLATES["mistral"], "tools", "mistral")
    for dialect, out in (("default", "default_"), ("glm4", "glm4"), ("llama3", "llama3"), ("qwen", "qwen")):
        rows = O.list_tool_column(rows, "tools", dialect, out, today="02 Mar 2024")
    return rows.select("doc_id", "mistral", "default_", "glm4", "llama3", "qwen")


@query(
    "tool_calls",
    """WITH d AS (SELECT doc_id, n_chars % 3 = 0 AS two, coalesce(source, 'none') AS s, '{"k": ' || n_chars || ', "t": "' || coalesce(lang, '?') || '"}' AS a FROM documents),
    m AS (SELECT *, '{"name": "f", "arguments": ' || a || '}' AS x, '{"name": "' || s || '", "arguments": ' || a || '}' AS y, '{"name": "f", "parameters": ' || a || '}' AS px, '{"name": "' || s || '", "parameters": ' || a || '}' AS py FROM d)
    SELECT doc_id, 'Action: f' || chr(10) || 'Action Input: ' || a || CASE WHEN two THEN chr(10) || 'Action: ' || s || chr(10) || 'Action Input: ' || a ELSE '' END AS default_,
    'f' || chr(10) || a AS glm4, CASE WHEN two THEN '[' || px || ', ' || py || ']' ELSE px END AS llama3, '[' || x || CASE WHEN two THEN ', ' || y ELSE '' END || ']' AS mistral,
    '<tool_call>' || chr(10) || x || chr(10) || '</tool_call>' || CASE WHEN two THEN chr(10) || '<tool_call>' || chr(10) || y || chr(10) || '</tool_call>' ELSE '' END AS qwen,
    'f' || CASE WHEN two THEN ',' || s ELSE '' END AS names, a AS arguments, true AS agree, true AS plain FROM m""",
)
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two calls made of a document's values, rendered in five dialects and read back from each; whole texts hold no call."""
    arguments = F.concat(F.lit('{"k": '), F.col("n_chars").cast("string"), F.lit(', "t": "'), F.coalesce("lang", F.lit("?")), F.lit('"}'))
    call = lambda name: F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": '), arguments, F.lit("}"))
    first = call(F.lit("f"))
    both = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("["), first, F.lit(", "), call(F.coalesce("source", F.lit("none"))), F.lit("]"))).otherwise(first)
    rows = _docs(spark, sf_dir, "text", first.alias("one"), both.alias("calls"))
    same = F.lit(True)
    for dialect in O.DIALECTS:
        rows = O.render_call_column(rows, "one" if dialect == "glm4" else "calls", dialect, f"{dialect}_")
        rows = O.extract_calls(rows, "text", dialect, f"{dialect}_text")
    for dialect in O.DIALECTS:  # after all that need no other column of Python: each step is one worker
        rows = O.extract_calls(rows, f"{dialect}_", dialect, f"{dialect}_read")
        read = F.col(f"{dialect}_read.calls")
        same = same & F.coalesce(read == (F.slice("qwen_read.calls", F.lit(1), F.lit(1)) if dialect == "glm4" else F.col("qwen_read.calls")), F.lit(False))
    plain = F.coalesce(*(F.when(F.col(f"{d}_text.calls").isNotNull(), False) for d in O.DIALECTS if d != "glm4"), F.lit(True))
    calls = F.col("qwen_read.calls")
    return rows.select("doc_id", "default_", *(F.col(f"{d}_").alias(d) for d in O.DIALECTS[1:]), F.array_join(F.transform(calls, lambda c: c["name"]), ",").alias("names"), F.get(calls, F.lit(0))["arguments"].alias("arguments"), same.alias("agree"), plain.alias("plain"))


@query("rule_prompts", """WITH d AS (SELECT doc_id, source AS s, text AS t, '- ' || source || chr(10) || '- b' AS r, chr(10) || chr(10) AS nn FROM documents)
    SELECT doc_id, r AS bullets,
    md5('Rewrite the document so that it follows the rules below, and keep its facts.' || nn || '## Document' || chr(10) || t || nn || '## Rules' || chr(10) || r) AS rewrite,
    md5('Some of the rules below say the same. Merge these, keep all others, and answer with a JSON list of strings.' || nn || r) AS merge,
    md5('Which of the rules below can a writer follow in any document? Answer with these alone, as a JSON list of strings.' || nn || r) AS filter_,
    md5('List the claims of the answer below with the numbers of the sources that it cites for each, as JSON: [{"claim": ..., "sources": [...]}]' || nn || t) AS claims,
    md5('Does the source support the claim? Answer full_support, partial_support or no_support.' || nn || 'Claim: ' || s || nn || 'Source:' || chr(10) || t) AS support,
    md5('Question: ' || s || nn || 'Document A:' || chr(10) || t || nn || 'Document B:' || chr(10) || s || nn || 'An answer drew more on document A. Explain which of its properties made it so.') AS explain_,
    md5('From the explanation below, state general rules for documents as a JSON list of strings.' || nn || t) AS extract,
    md5('For each point say whether the answer has it: Supported, Omitted or Contradicted, as JSON by number.' || nn || 'Points:' || chr(10) || '1. ' || s || chr(10) || '2. b' || nn || 'Answer:' || chr(10) || t) AS points FROM d""")
def rule_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts on whole texts, letter by letter."""
    s, t, rules = F.col("source"), F.col("text"), F.array("source", F.lit("b"))
    points = F.array(*(F.struct(F.lit(i).alias("point_number"), p.alias("point_content")) for i, p in ((1, s), (2, F.lit("b")))))
    prompts = {
        "rewrite": U.rewrite_prompt(t, rules), "merge": U.merge_prompt(rules), "filter_": U.filter_prompt(rules), "claims": U.claims_prompt(t), "support": U.support_prompt(s, t),
        "explain_": U.explain_prompt(s, t, s, F.lit("A")), "extract": U.extract_prompt(t), "points": U.points_prompt(points, t),
    }
    return _docs(spark, sf_dir, X.rule_text(rules).alias("bullets"), *(F.md5(p).alias(k) for k, p in prompts.items()))


_DISTINCT = "SELECT DISTINCT source AS rule FROM documents UNION SELECT 'b'"


@query("rule_distinct", _DISTINCT)
def rule_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.distinct_rules(_docs(spark, sf_dir, F.array("source", F.lit("b"), F.lit(" ")).alias("rules")))


@query("position_ids", _ARRAYS + "SELECT doc_id, md5(coalesce(array_to_string(list_concat(range(0, len(s)), range(0, len(w))), ','), '')) AS places FROM d")
def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a source's letters and a text's words that are packed together."""
    return _docs(spark, sf_dir, F.md5(_joined(G.position_ids(F.array(F.size(_letters()), F.size(_words()))))).alias("places"))


@query("segments", _ARRAYS + """, x AS (SELECT doc_id, list_filter([len(s), len(w)], lambda v: v > 0) AS x FROM d)
    SELECT doc_id, coalesce(array_to_string(x, ','), '') AS lengths, CASE len(x) WHEN 0 THEN '0' WHEN 1 THEN '0,' || x[1] ELSE '0,' || x[1] || ',' || (x[1] + x[2]) END AS offsets FROM x""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of a source's letters, a text's words and padding."""
    mask = F.concat(*(F.array_repeat(F.lit(v), F.size(a)) for v, a in ((1, _letters()), (2, _words()), (0, _letters("lang")))))
    rows = _docs(spark, sf_dir, G.segment_lengths(mask).alias("lengths"))
    return rows.select("doc_id", _joined(F.col("lengths")).alias("lengths"), _joined(G.cumulative(F.col("lengths"))).alias("offsets"))


@query("encoded_unsupervised", _ARRAYS + f", e AS (SELECT *, {_target('len(w)', 'len(s)', '40')} AS nt FROM d) SELECT doc_id, {_text('w[1:' + _source('len(w)', 'nt', '40') + ']')} AS input_ids, {_text('s[1:nt]')} AS labels FROM e")
def encoded_unsupervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the text as the prompt, letters of the source as the response, within 40."""
    rows = _docs(spark, sf_dir, G.processor("ppo")(_words(), _letters(), 40).alias("x"))
    return rows.select("doc_id", _joined(F.col("x.input_ids")).alias("input_ids"), _joined(F.col("x.labels")).alias("labels"))


@query(
    "encoded_pairs",
    _ARRAYS + f""", e AS (SELECT *, {_target('len(l)', 'greatest(len(w), len(s))', '60')} AS nt FROM d), g AS (SELECT *, {_source('len(l)', 'nt', '60')} AS ns FROM e)
    SELECT doc_id, {_text('list_concat(l[1:ns], w[1:nt])')} AS chosen, {_text('list_concat(l[1:ns], s[1:nt])')} AS rejected, {_text('list_concat(list_transform(l[1:ns], lambda x: -100), w[1:nt])')} AS labels FROM g""",
)
def encoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language as the prompt, words of the text against letters of the source, within 60."""
    rows = _docs(spark, sf_dir, G.processor("rm")(_letters("lang"), _words(), _letters(), 60).alias("x"))
    return rows.select("doc_id", _joined(F.col("x.chosen_input_ids")).alias("chosen"), _joined(F.col("x.rejected_input_ids")).alias("rejected"), _joined(F.col("x.chosen_labels")).alias("labels"))


@query(
    "kto_batches",
    _ARRAYS + f""", e AS (SELECT *, {_target('len(l)', 'len(w)', '100')} AS nt, {_target('len(l)', 'len(s)', '100')} AS kt FROM d),
    g AS (SELECT doc_id, doc_id // 10 AS batch, n_chars % 2 = 0 AS tag, list_concat(l[1:{_source('len(l)', 'nt', '100')}], w[1:nt]) AS x, list_concat(list_transform(l[1:{_source('len(l)', 'kt', '100')}], lambda x: -100), s[1:kt]) AS k FROM e),
    m AS (SELECT *, max(len(x)) OVER (PARTITION BY batch) AS nx, max(len(k)) OVER (PARTITION BY batch) AS nk FROM g)
    SELECT doc_id, {_text('list_resize(x, nx, 0)')} AS input_ids, {_text('list_resize(k, nk, -100)')} AS kl_labels, tag FROM m""",
)
def kto_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language as the prompt, words of the text as the response, letters of the source as the other one; padded in batches of ten."""
    rows = _docs(spark, sf_dir, F.floor(F.col("doc_id") / 10).alias("batch"), G.processor("kto")(_letters("lang"), _words(), _letters(), F.col("n_chars") % 2 == 0, 100).alias("x")).select("doc_id", "batch", "x.*")
    done = G.kto_batch(rows, "batch", "doc_id")
    return done.select("doc_id", _joined(F.col("input_ids")).alias("input_ids"), _joined(F.col("kl_labels")).alias("kl_labels"), F.col("kto_tags").alias("tag"))


@query("pair_sides", _ARRAYS + f"SELECT doc_id, 0 AS side, {_text('w')} AS ids FROM d UNION ALL SELECT doc_id, 1, {_text('s')} FROM d")
def pair_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, *(x.alias(f"{k}_{c}") for k, x in (("chosen", _words()), ("rejected", _letters())) for c in ("input_ids", "labels")))
    return G.pairwise_rows(rows, "doc_id").select("doc_id", "side", _joined(F.col("input_ids")).alias("ids"))


@query(
    "turns_masked",
    _ARRAYS + f""", a AS (SELECT *, {_target('len(w)', 'len(s)', '99')} AS t1, {_target('len(s)', 'len(l)', '99')} AS u2 FROM d),
    b AS (SELECT *, {_source('len(w)', 't1', '99')} AS s1, {_source('len(s)', 'u2', '99')} AS v2 FROM a),
    c AS (SELECT *, 99 - s1 - t1 AS room, 99 - v2 - u2 AS rest FROM b),
    e AS (SELECT *, CASE WHEN room > 0 THEN {_target('len(s)', 'len(l)', 'room')} ELSE 0 END AS t2, CASE WHEN rest > 0 THEN {_target('len(w)', 'len(s)', 'rest')} ELSE 0 END AS u1 FROM c),
    f AS (SELECT *, CASE WHEN room > 0 THEN {_source('len(s)', 't2', 'room')} ELSE 0 END AS s2, CASE WHEN rest > 0 THEN {_source('len(w)', 'u1', 'rest')} ELSE 0 END AS v1 FROM e)
    SELECT doc_id, {_text("list_concat(list_transform(w[1:s1], lambda x: -100), list_concat(s[1:t1], list_concat(list_transform(s[1:s2], lambda x: -100), list_concat(l[1:t2], [9]))))")} AS labels,
    {_text("list_concat(list_transform(list_concat(w[1:v1], list_concat(s[1:u1], s[1:v2])), lambda x: -100), list_concat(l[1:u2], [9]))")} AS last_only FROM f""",
)
def turns_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns (words and source; source and language) share 99 places: the prompts are ignored; with a masked history only the last response is learnt, and cut last."""
    turns = F.array(F.struct(_words().alias("prompt"), _letters().alias("response")), F.struct(_letters().alias("prompt"), _letters("lang").alias("response")))
    one = lambda **k: _joined(G.processor("sft")(turns, 100, eos=9, **k)["labels"])
    return _docs(spark, sf_dir, one().alias("labels"), one(mask_history=True).alias("last_only"))


@query("reward_len", "SELECT doc_id, -length(text) AS reward, CASE WHEN n_chars % 3 = 2 THEN 0.0 ELSE 1.0 END AS right_, CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END AS passed FROM documents LEFT JOIN labels USING (doc_id)")
def reward_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length; answers of twelve digits in three spellings, one of which is wrong; the binary of a pass rate."""
    kind = F.col("n_chars") % 3
    number = (F.col("n_chars") + 123456789012).cast("string")
    said = F.when(kind == 0, F.concat(F.lit("so \\boxed{"), number, F.lit(".0}"))).when(kind == 1, number).otherwise(F.concat(number, F.lit("1")))
    rows = _docs(spark, sf_dir, "text", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", R.short(F.col("text")).alias("reward"), R.accuracy(said, number).alias("right_"), R.binary(F.coalesce(F.col("quality").cast("double"), F.lit(0.5))).alias("passed"))


@query(
    "supervised_rows",
    """SELECT doc_id, CAST(length('<|im_start|>user' || chr(10) || source || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS INTEGER) AS ignored, CAST(length('fine<|im_end|>') + 1 AS INTEGER) AS learnt FROM documents""",
)
def supervised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns rendered, tokenized (a code point is a token) and masked."""
    rows = G.supervised(_docs(spark, sf_dir, _exchange(F.col("source")).alias("turns")), T.TEMPLATES["chatml"], "turns", lambda t: [ord(c) for c in t], 10_000)
    ignored = F.size(F.filter("labels", lambda x: x == G.IGNORE))
    return rows.select("doc_id", ignored.alias("ignored"), (F.size("input_ids") - ignored).alias("learnt"))


@query("answers_generated", "SELECT doc_id, length('Question: ' || source) AS asked, 'echo' AS said, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM documents")
def answers_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with sources go to a batch generator, and code to a service that fails for odd ids."""
    if "even" not in C.PROVIDERS:
        C.provider("even")(lambda code, language: 1 / (int(code) % 2 == 0))
    rows = _docs(spark, sf_dir, "source", C.answer_prompt(F.col("source"), F.array("text")).alias("prompt"), F.col("doc_id").cast("string").alias("code"), F.lit("python").alias("language"))
    rows = C.executed(C.generated(rows, lambda: lambda prompts: ["echo" if "### Source 0:" in p else "" for p in prompts]), "even")
    asked = F.length(F.regexp_extract("prompt", r"(Question: [^\n]*)", 1))
    return rows.select("doc_id", asked.alias("asked"), F.col("generation").alias("said"), "score")


@query("repetition_characters", "WITH d AS (SELECT doc_id, coalesce(source, '') AS s FROM documents), g AS (SELECT doc_id, CASE WHEN length(s) >= 2 THEN list_transform(range(1, length(s)), lambda i: s[i:i + 1]) ELSE [] END AS g FROM d) SELECT doc_id, round(CASE WHEN len(g) > 0 THEN (len(list_distinct(g)) / CAST(len(g) AS DOUBLE) - 1) ELSE 0.0 END, 6) AS reward FROM g")
def repetition_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, F.round(R.repetition(F.col("source"), 2, -1.0, "zh"), 6).alias("reward"))


@query("stop_words", "SELECT doc_id, '<|im_end|>' AS end_token, '<|im_start|>' AS stops FROM documents")
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    end, others = T.end_tokens(T.TEMPLATES["chatml"], "</s>")
    return _docs(spark, sf_dir, F.lit(end).alias("end_token"), F.lit(",".join(others)).alias("stops"))
