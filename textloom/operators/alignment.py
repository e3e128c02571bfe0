"""Instruction data in one shape: _prompt and _response as arrays of turns, _system, _tools and media."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONVERTERS: dict[str, Callable[..., DataFrame]] = {}
_TURNS = "array<struct<role:string,content:string>>"


def register(name: str):
    def add(f):
        if name in CONVERTERS:
            raise ValueError(f"converter {name} exists")
        CONVERTERS[name] = f
        return f

    return add


def converter(name: str) -> Callable[..., DataFrame]:
    if name not in CONVERTERS:
        raise ValueError(f"converter {name} does not exist")
    return CONVERTERS[name]


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _none() -> Column:
    return F.array().cast(_TURNS)


def _media(df: DataFrame) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(None).cast("array<string>")).alias(f"_{c}") for c in ("images", "videos", "audios")]


def _text(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")


@register("alpaca")
def alpaca(df: DataFrame, prompt: str = "instruction", query: str = "input", response: str = "output", history: str = "history", system: str = "system", tools: str = "tools", chosen: str = "chosen", rejected: str = "rejected", kto_tag: str = "kto_tag", keep: list[str] | None = None) -> DataFrame:
    """Earlier question-answer pairs, then prompt and query on lines of their own; the response is one turn, chosen and rejected, or marked good or bad.

    Columns that are missing count as empty. A row with a tag has the response and an empty one (the other
    way round for a false tag).
    """
    keep = keep or []
    past = F.flatten(F.transform(F.coalesce(F.col(history), F.array().cast("array<array<string>>")), lambda h: F.array(turn("user", F.get(h, F.lit(0))), turn("assistant", F.get(h, F.lit(1)))))) if history in df.columns else _none()
    asked = F.array_join(F.filter(F.array(_text(df, prompt), _text(df, query)), lambda x: x != ""), "\n")
    if kto_tag in df.columns:
        said, other = turn("assistant", F.col(response)), turn("assistant", F.lit(""))
        answer = F.when(F.col(kto_tag), F.array(said, other)).otherwise(F.array(other, said))
    elif chosen in df.columns and rejected in df.columns:
        answer = F.array(turn("assistant", F.col(chosen)), turn("assistant", F.col(rejected)))
    elif response in df.columns:
        answer = F.when(F.col(response).isNotNull(), F.array(turn("assistant", F.col(response)))).otherwise(_none())
    else:
        answer = _none()
    return df.select(*keep, F.concat(past, F.array(turn("user", asked))).alias("_prompt"), answer.alias("_response"), _text(df, system).alias("_system"), _text(df, tools).alias("_tools"), *_media(df))


@register("sharegpt")
def sharegpt(df: DataFrame, messages: str = "conversations", role: str = "from", content: str = "value", tags: dict[str, str] | None = None, system: str = "system", tools: str = "tools", chosen: str = "chosen", rejected: str = "rejected", kto_tag: str = "kto_tag", keep: list[str] | None = None) -> DataFrame:
    """Messages with roles, alternately of the asking (user, observation) and the answering side (assistant, function).

    A leading system message becomes _system. A row breaks the rule if a role is on the wrong side or
    unknown, or if the number of messages is odd (even for ranked rows); it then has empty turns.
    """
    keep = keep or []
    names = {"user": "human", "assistant": "gpt", "observation": "observation", "function": "function_call", "system": "system"} | (tags or {})
    ask, answer = [names["user"], names["observation"]], [names["assistant"], names["function"]]
    to = F.create_map(*(x for k, v in names.items() for x in (F.lit(v), F.lit(k))))
    rank = chosen in df.columns and rejected in df.columns
    m = F.coalesce(F.col(messages), F.array())
    df = df.withColumn("_led", (F.size(m) > 0) & (F.get(m, F.lit(0))[role] == names["system"]))
    df = df.withColumn("_said", F.when(F.col("_led"), F.slice(m, 2, F.greatest(F.size(m), F.lit(1)))).otherwise(m))
    fits = F.forall(F.transform("_said", lambda x, i: F.when(i % 2 == 0, x[role].isin(ask)).otherwise(x[role].isin(answer))), lambda ok: F.coalesce(ok, F.lit(False)))
    odd = F.size("_said") % 2 == 1
    good = fits & (odd if rank else ~odd)
    if rank:
        good = good & F.coalesce(F.col(chosen)[role].isin(answer) & F.col(rejected)[role].isin(answer), F.lit(False))
    turns = F.transform("_said", lambda x: F.struct(F.try_element_at(to, x[role]).alias("role"), x[content].alias("content")))
    df = df.withColumn("_good", good).withColumn("_turns", turns)
    one = lambda c: F.struct(F.try_element_at(to, F.col(c)[role]).alias("role"), F.col(c)[content].alias("content"))
    last = F.slice("_turns", F.greatest(F.size("_turns"), F.lit(1)), 1)
    first = F.slice("_turns", F.lit(1), F.greatest(F.size("_turns") - 1, F.lit(0)))
    if kto_tag in df.columns:
        blank = F.array(turn("assistant", F.lit("")))
        prompt, response = first, F.when(F.col(kto_tag), F.concat(last, blank)).otherwise(F.concat(blank, last))
    elif rank:
        prompt, response = F.col("_turns"), F.array(one(chosen), one(rejected))
    else:
        prompt, response = first, last
    led = F.when(F.col("_led"), F.get(m, F.lit(0))[content]).otherwise(_text(df, system))
    pick = lambda x: F.when(F.col("_good"), x).otherwise(_none())
    return df.select(*keep, pick(prompt).alias("_prompt"), pick(response).alias("_response"), led.alias("_system"), _text(df, tools).alias("_tools"), *_media(df))


def valid(df: DataFrame, responses: int = 1) -> DataFrame:
    """Rows to train on: an odd number of prompt turns and so many responses (two or more when ranked)."""
    enough = F.size("_response") == 1 if responses == 1 else F.size("_response") >= responses
    return df.where((F.size("_prompt") % 2 == 1) & enough)


def alternating(data: Column) -> Column:
    """A list of texts as turns of human and gpt; an odd last one goes; under two there are none."""
    even = F.slice(data, F.lit(1), F.size(data) - F.size(data) % 2)
    return F.transform(even, lambda x, i: F.struct(F.when(i % 2 == 0, "human").otherwise("gpt").alias("from"), x.alias("value")))


def split_dialogue(text: Column, human: str = "Human:", assistant: str = "Assistant:") -> Column:
    """Turns of a text that marks speakers; what stands before the first mark is not a turn."""
    marked = F.replace(F.replace(text, F.lit(human), F.lit("\x01h")), F.lit(assistant), F.lit("\x01a"))
    parts = F.split(marked, "\x01")
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(F.when(p.startswith("h"), "human").otherwise("gpt").alias("from"), F.regexp_replace(F.substring(p, 2, 2**31 - 1), r"^\s+|\s+$", "").alias("value")))


def last_exchange(text: Column, human: str = "\n\nHuman: ", assistant: str = "\n\nAssistant: ") -> Column:
    """struct<instruction, answer, history> of a dialogue that ends with an answer."""
    answer = F.substring_index(text, assistant, -1)
    before = F.substring(text, F.lit(1), F.length(text) - F.length(answer) - len(assistant))
    asked = F.substring_index(before, human, -1)
    past = F.substring(before, F.lit(1), F.length(before) - F.length(asked) - len(human))
    pairs = F.transform(F.filter(F.split(past, human), lambda x: x != ""), lambda x: F.split(x, assistant))
    return F.struct(asked.alias("instruction"), answer.alias("answer"), pairs.alias("history"))


def chat_prompt(df: DataFrame, prompt: str, system: str | None = None, out: str = "prompt") -> DataFrame:
    """A system turn, if there is one, and the prompt as the user's."""
    turns = [turn("user", F.col(prompt))]
    if system:
        turns.insert(0, turn("system", F.lit(system)))
    return df.withColumn(out, F.array(*turns))


def placeholders(text: Column, mark: str, tokens: Column) -> Column:
    """Each mark as so many of itself."""
    return F.replace(text, F.lit(mark), F.repeat(F.lit(mark), tokens))


def image_size(width: Column, height: Column, most: int = 768 * 768, least: int = 32 * 32) -> Column:
    """struct<width, height> within the bounds of pixels, by one factor for both sides."""
    down = F.when(width * height > most, F.sqrt(most / (width * height))).otherwise(F.lit(1.0))
    w, h = (width * down).cast("int"), (height * down).cast("int")
    up = F.when(w * h < least, F.sqrt(least / (w * h))).otherwise(F.lit(1.0))
    return F.struct((w * up).cast("int").alias("width"), (h * up).cast("int").alias("height"))


def video_frames(frames: Column, seconds: Column, fps: float = 2.0, most: int = 128) -> Column:
    """Indices of frames spread evenly: so many a second, at most ``most``."""
    n = F.greatest(F.least(F.floor(seconds * fps), F.lit(most), frames), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n > 1, F.floor(i * (frames - 1) / (n - 1))).otherwise(F.lit(0)).cast("int"))


def few_shot(question: Column, choices: dict[str, Column], answer: Column, support: Column, subject: Column, lang: str = "en") -> Column:
    """Turns of a multiple-choice question after its supporting examples (array of struct question, A.., answer)."""
    # The prompts that results are compared under.
    head = {"en": ("The following are multiple choice questions (with answers) about ", ".\n\n", "\nAnswer:"), "zh": ("以下是中国关于", "考试的单项选择题，请选出其中的正确答案。\n\n", "\n答案：")}[lang]

    def asked(q: Column, cs: dict[str, Column]) -> Column:
        return F.concat(q, *(F.concat(F.lit(f"\n{k}. "), c) for k, c in cs.items()), F.lit(head[2]))

    past = F.flatten(F.transform(support, lambda s: F.array(turn("user", asked(s["question"], {k: s[k] for k in choices})), turn("assistant", s["answer"]))))
    turns = F.concat(past, F.array(turn("user", asked(question, choices)), turn("assistant", answer)))
    return F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == 0, F.concat(F.lit(head[0]), subject, F.lit(head[1]), t["content"])).otherwise(t["content"]).alias("content")))


def resolve_media(df: DataFrame, files: DataFrame, folder: str, key: str, column: str = "_images") -> DataFrame:
    """Media names that exist below ``folder`` become paths, others stay; files: path. A null or empty list is null."""
    there = files.select(F.regexp_replace("path", r"^file:/*", "/").alias("_path")).distinct()
    refs = df.select(key, F.posexplode_outer(column).alias("_i", "_ref")).withColumn("_path", F.concat(F.lit(folder.rstrip("/") + "/"), "_ref"))
    found = refs.join(there.withColumn("_there", F.lit(True)), "_path", "left").where("_ref is not null")
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", F.when(F.col("_there"), F.col("_path")).otherwise(F.col("_ref")).alias("p")))).alias("_m"))
    return df.drop(column).join(lists.select(key, F.transform("_m", lambda m: m["p"]).alias(column)), key, "left")


def check_stage(ranking: bool, stage: str) -> None:
    """Ranked data are for the reward model's stage, others for the other stages."""
    if (stage == "rm") != ranking:
        raise ValueError(f"ranked: {ranking}; these data are not for stage {stage}")


def check_media(df: DataFrame, marks: dict[str, str] | None = None, turns: str = "_prompt") -> DataFrame:
    """``df``; a row whose number of marks in its turns is not that of its media is an error when it is computed. marks: column of media -> mark."""
    marks = marks or {"_images": "<image>", "_videos": "<video>", "_audios": "<audio>"}
    for column, mark in marks.items():
        said = F.aggregate(turns, F.lit(0), lambda n, t: n + F.size(F.split(t["content"], rf"\Q{mark}\E", -1)) - 1)
        media = F.coalesce(F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.size(column)), F.lit(0))
        df = df.withColumn(column, F.when(said == media, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"marks {mark}: "), said.cast("string"), F.lit(", media: "), media.cast("string"))).cast("array<string>")))
    return df


def media_counts(turns: Column, mark: str) -> Column:
    """How often a mark is in the contents of turns."""
    return F.aggregate(turns, F.lit(0), lambda n, t: n + F.size(F.split(t["content"], rf"\Q{mark}\E", -1)) - 1)


def support_draw(support: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """(by, support): ``n`` rows of each subject, drawn by a keyed hash, as an array of structs in drawn order; all of them where there are fewer."""
    others = [c for c in support.columns if c != by]
    place = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    ranked = support.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(place, key))).where(F.col("_at") <= n)
    lists = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_at", F.struct(*others).alias("row")))).alias("rows"))
    return lists.select(by, F.transform("rows", lambda r: r["row"]).alias("support"))
