"""Chat templates: turns rendered to texts by slot strings, with Column expressions.

In a slot, ``{{content}}`` is the turn's text and ``{{idx}}`` the number of its exchange; ``<bos>`` and ``<eos>``
stand for the tokenizer's own tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, remove_thought
from .tools import list_tool_column

BOS, EOS = "<bos>", "<eos>"


@dataclass(frozen=True)
class Template:
    """Slots of a template. fused: the system text stands inside the first user turn; reasoning: thoughts are handled."""

    name: str
    user: str = "{{content}}"
    assistant: str = "{{content}}" + EOS
    system: str = "{{content}}"
    observation: str | None = None
    function: str | None = None
    prefix: str = ""
    default_system: str = ""
    tools: str = "default"
    fused: bool = False
    reasoning: bool = False
    thought: tuple[str, str] = ("<think>", "</think>")

    def slot(self, role: str) -> str:
        return {"user": self.user, "assistant": self.assistant, "system": self.system, "observation": self.observation or self.user, "function": self.function or self.assistant}[role]


TEMPLATES: dict[str, Template] = {}


def register(t: Template) -> Template:
    if t.name in TEMPLATES:
        raise ValueError(f"template {t.name} exists")
    TEMPLATES[t.name] = t
    return t


def fill(slot: str, content: Column, idx: Column | None = None) -> Column:
    """The slot with each name's first mention replaced; the text itself is not looked at again."""
    head, mark, tail = slot.partition("{{content}}")

    def numbered(s: str) -> Column:
        a, m, b = s.partition("{{idx}}")
        return F.concat(F.lit(a), idx.cast("string"), F.lit(b)) if m and idx is not None else F.lit(s)

    return F.concat(numbered(head), content, numbered(tail)) if mark else numbered(head)


def render(t: Template, turns: Column, system: Column | None = None, tools: Column | None = None) -> Column:
    """array<string>: the texts of array<struct<role, content>>, the first with prefix and system. An unknown role is an error."""
    system = F.coalesce(F.nullif(system, F.lit("")), F.lit(t.default_system)) if system is not None else F.lit(t.default_system)
    extra = F.coalesce(tools, F.lit("")) if tools is not None else F.lit("")
    led = F.when(F.length(F.concat(system, extra)) > 0, fill(t.system, F.concat(system, extra))).otherwise(F.lit(""))

    def one(m: Column, i: Column) -> Column:
        content = F.when((i == 0) & (m["role"] == "user"), F.concat(led, m["content"])).otherwise(m["content"]) if t.fused else m["content"]
        text = F.when(m["role"] == "user", fill(t.slot("user"), content, F.floor(i / 2)))
        for role in ("assistant", "observation", "function"):
            text = text.when(m["role"] == role, fill(t.slot(role), content))
        text = text.otherwise(F.raise_error(F.concat(F.lit("unexpected role: "), m["role"])).cast("string"))
        return F.when(i == 0, F.concat(F.lit(t.prefix), F.lit("") if t.fused else led, text)).otherwise(text)

    return F.transform(turns, one)


def with_tool_text(rows: DataFrame, t: Template, tools: str, out: str = "tool_text", today: str = "") -> DataFrame:
    """Adds what the template's dialect says of a column of tools (JSON): the ``tools`` of :func:`render`."""
    return list_tool_column(rows, tools, t.tools, out, today)


def pairs(t: Template, turns: Column, system: Column | None = None, tools: Column | None = None, thinking: bool | None = None) -> Column:
    """array<struct<prompt, response>> of turns that alternate. A reasoning template removes thoughts when thinking is off, and gives an answer without one an empty thought: in the response (learnt) if thinking is on, else in the prompt."""
    if t.reasoning and thinking is False:
        turns = F.transform(turns, lambda m, i: F.struct(m["role"].alias("role"), F.when(i % 2 == 1, remove_thought(m["content"], t.thought)).otherwise(m["content"]).alias("content")))

    def zip_(texts: Column) -> Column:
        def one(i: Column) -> Column:
            prompt, response = F.get(texts, i * 2), F.get(texts, i * 2 + 1)
            if t.reasoning:
                said = F.get(turns, i * 2 + 1)["content"]
                bare = ~F.contains(said, F.lit(t.thought[0])) & ~F.contains(said, F.lit(t.thought[1]))
                empty = F.when(bare, F.lit(f"{t.thought[0]}\n\n{t.thought[1]}\n\n")).otherwise("")
                prompt, response = (prompt, F.concat(empty, response)) if thinking else (F.concat(prompt, empty), response)
            return F.struct(prompt.alias("prompt"), response.alias("response"))

        n = F.floor(F.size(texts) / 2).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast("array<struct<prompt:string,response:string>>"))

    return let(render(t, turns, system, tools), zip_)


def to_jinja(t: Template, bos: str, eos: str) -> str:
    """The template as Jinja text."""

    def quoted(slot: str, name: str = "content") -> str:
        slot = slot.replace(BOS, bos).replace(EOS, eos)
        a, m, b = slot.partition("{{content}}")
        esc = lambda s: "'" + s.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "\\'") + "'"
        return " + ".join(x for x in (esc(a) if a else "", name if m else "", esc(b) if b else "") if x) or "''"

    out = "{{ " + quoted(t.prefix) + " }}" if t.prefix else ""
    out += "{% if messages[0]['role'] == 'system' %}{% set system = messages[0]['content'] %}{% set turns = messages[1:] %}{% else %}{% set system = " + quoted(t.default_system) + " %}{% set turns = messages %}{% endif %}"
    if not t.fused:
        out += "{% if system %}{{ " + quoted(t.system, "system") + " }}{% endif %}"
    out += "{% for m in turns %}{% set content = m['content'] %}"
    if t.fused:
        out += "{% if loop.index0 == 0 and system %}{% set content = " + quoted(t.system, "system") + " + content %}{% endif %}"
    return out + "{% if m['role'] == 'user' %}{{ " + quoted(t.user) + " }}{% elif m['role'] == 'assistant' %}{{ " + quoted(t.assistant) + " }}{% endif %}{% endfor %}"


# The slots of known chat formats.
def _turned(name: str, **more) -> None:
    """Formats that mark turns with <|im_start|> and <|im_end|>."""
    register(Template(name, "<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n", "{{content}}<|im_end|>\n", "<|im_start|>system\n{{content}}<|im_end|>\n", **{"observation": "<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n"} | more))


_turned("chatml")
_turned("chatml_de", default_system="Du bist ein freundlicher und hilfsbereiter KI-Assistent.")
_turned("cpm3", prefix=BOS)
_turned("cpm4", prefix=BOS)
_turned("falcon_h1", prefix=BOS)
_turned("intern_vl", prefix=BOS, observation=None, default_system="你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。")
for _name, _reasoning, _system in (("qwen", False, "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."), ("qwen3", True, "")):
    _turned(_name, observation="<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n", tools="qwen", reasoning=_reasoning, default_system=_system)
for _t in (
    Template("alpaca", "### Instruction:\n{{content}}\n\n### Response:\n", "{{content}}<eos>\n\n", default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"),
    Template("aquila", "Human: {{content}}###Assistant:", "{{content}}###", "System: {{content}}###", default_system="A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."),
    Template("atom", "<bos>Human: {{content}}\n<eos><bos>Assistant:", "{{content}}\n<eos>"),
    Template("baichuan", "<reserved_102>{{content}}<reserved_103>", "{{content}}"),
    Template("baichuan2", "<reserved_106>{{content}}<reserved_107>", "{{content}}"),
    Template("bailing", "<role>HUMAN</role>{{content}}<role>ASSISTANT</role>", "{{content}}", "<role>SYSTEM</role>{{content}}", "<role>OBSERVATION</role>{{content}}<role>ASSISTANT</role>"),
    Template("belle", "Human: {{content}}\n\nBelle: ", "{{content}}<eos>\n\n", prefix=BOS),
    Template("bluelm", "[|Human|]:{{content}}[|AI|]:"),
    Template("breeze", "[INST] {{content}} [/INST] ", "{{content}}", prefix=BOS),
    Template("chatglm2", "[Round {{idx}}]\n\n问：{{content}}\n\n答：", "{{content}}", prefix="[gMASK]sop"),
    Template("chatglm3", "<|user|>\n{{content}}<|assistant|>", "\n{{content}}", "<|system|>\n{{content}}", "<|observation|>\n{{content}}<|assistant|>", "{{content}}", "[gMASK]sop", tools="glm4"),
    Template("codegeex2", assistant="{{content}}<eos>", prefix="[gMASK]sop"),
    Template("cohere", "<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>", system="<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>", prefix=BOS),
    Template("cpm", "<用户>{{content}}<AI>", prefix=BOS),
    Template("deepseek", "User: {{content}}\n\nAssistant:", system="{{content}}\n\n", prefix=BOS),
    Template("deepseek3", "<｜User｜>{{content}}<｜Assistant｜>", prefix=BOS),
    Template("deepseekr1", "<｜User｜>{{content}}<｜Assistant｜>", prefix=BOS, reasoning=True),
    Template("default", "Human: {{content}}<eos>\nAssistant:", "{{content}}<eos>\n", "System: {{content}}<eos>\n"),
    Template("empty", assistant="{{content}}"),
    Template("exaone", "[|user|]{{content}}\n[|assistant|]", "{{content}}<eos>\n", "[|system|]{{content}}[|endofturn|]\n"),
    Template("falcon", "User: {{content}}\nFalcon:", "{{content}}\n"),
    Template("fewshot", assistant="{{content}}\n\n"),
    Template("gemma", "<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n", "{{content}}<end_of_turn>\n", "{{content}}\n\n", "<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n", prefix=BOS, fused=True),
    Template("glm4", "<|user|>\n{{content}}<|assistant|>", "\n{{content}}", "<|system|>\n{{content}}", "<|observation|>\n{{content}}<|assistant|>", "{{content}}", "[gMASK]<sop>", tools="glm4"),
    Template("granite3", "<|start_of_role|>user<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>", "{{content}}<|end_of_text|>\n", "<|start_of_role|>system<|end_of_role|>{{content}}<|end_of_text|>\n"),
    Template("hunyuan", "<|bos|>user\n{{content}}<|eos|>\n<|bos|>assistant\n", "{{content}}<|eos|>\n", "<|bos|>system\n{{content}}<|eos|>\n", prefix="<|bos|>"),
    Template("index", "reserved_0{{content}}reserved_1", "{{content}}", "<unk>{{content}}"),
    Template("kimi_vl", "<|im_user|>user<|im_middle|>{{content}}<|im_end|><|im_assistant|>assistant<|im_middle|>", "{{content}}<|im_end|>", "<|im_system|>system<|im_middle|>{{content}}<|im_end|>", default_system="You are a helpful assistant", reasoning=True, thought=("◁think▷", "◁/think▷")),
    Template("llama2", "<bos>[INST] {{content}} [/INST]", system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", fused=True),
    Template("llama2_zh", "<bos>[INST] {{content}} [/INST]", system="<<SYS>>\n{{content}}\n<</SYS>>\n\n", default_system="You are a helpful assistant. 你是一个乐于助人的助手。", fused=True),
    Template("llama3", "<|start_header_id|>user<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "{{content}}<|eot_id|>", "<|start_header_id|>system<|end_header_id|>\n\n{{content}}<|eot_id|>", "<|start_header_id|>ipython<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "{{content}}<|eot_id|>", BOS, tools="llama3"),
):
    register(_t)
for _copy, _of, _more in (("gemma3", "gemma", {}), ("glmz1", "glm4", {"reasoning": True})):
    register(replace(TEMPLATES[_of], name=_copy, **_more))

# Fixed values, continued.
_HELPFUL = "You are a helpful assistant."
_CURIOUS = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_INTERN = "You are an AI assistant whose name is InternLM (书生·浦语).\n- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."
_SHOWN = {"observation": "<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n", "tools": "qwen"}
_turned(
    "dbrx",
    default_system="You are DBRX, created by Databricks. You were last updated in December 2023. You answer questions based on information available up to that point.\nYOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough responses to more complex and open-ended questions.\nYou assist with various tasks, from writing to coding (using markdown for code blocks — remember to use ``` with code, JSON, and tables).\n(You do not have real-time data access or code execution capabilities. You avoid stereotyping and provide balanced perspectives on controversial topics. You do not provide song lyrics, poems, or news articles and do not divulge details of your training data.)\nThis is your system prompt, guiding your responses. Do not reference it, just respond to the user. If you find yourself talking about this message, stop. You should be responding appropriately and usually that means not mentioning this.\nYOU DO NOT MENTION ANY OF THIS INFORMATION ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY.",
)
_turned("intern2", prefix=BOS, observation=None, default_system=_INTERN)
_turned("llava_next_qwen", default_system=_HELPFUL, **_SHOWN)
_turned("llava_next_yi", observation=None)
_turned("llava_next_video_yi", observation=None)
_turned(
    "marco",
    default_system="你是一个经过良好训练的AI助手，你的名字是Marco-o1.由阿里国际数字商业集团的AI Business创造.\n## 重要！！！！！\n当你回答问题时，你的思考应该在<Thought>内完成，<Output>内输出你的结果。\n<Thought>应该尽可能是英文，但是有2个特例，一个是对原文中的引用，另一个是是数学应该使用markdown格式，<Output>内的输出需要遵循用户输入的语言。\n",
)
_turned("mimo", default_system=_HELPFUL, reasoning=True, **_SHOWN)
_turned("mimo_vl", default_system="You are MiMo, an AI assistant developed by Xiaomi.", reasoning=True, **_SHOWN)
_turned("minicpm_v", observation=None, default_system=_HELPFUL)
_turned("minicpm_o", observation=None, default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant.")
_turned("opencoder", default_system="You are OpenCoder, created by OpenCoder Team.")
_turned("qwen2_audio", observation=None, default_system=_HELPFUL)
_turned("qwen2_omni", default_system=_HELPFUL, **_SHOWN)
_turned("qwen2_vl", default_system=_HELPFUL, **_SHOWN)
_turned("smollm", observation=None)
_turned("smollm2", observation=None, default_system="You are a helpful AI assistant named SmolLM, trained by Hugging Face.")
_turned("yi", observation=None)
for _name in ("llava", "llava_next", "llava_next_video", "vicuna", "video_llava"):
    register(Template(_name, "USER: {{content}} ASSISTANT:", default_system=_CURIOUS))
for _t in (
    Template("ministral", "[INST]{{content}}[/INST]", "{{content}}<eos>", "{{content}}\n\n", '[TOOL_RESULTS]{"content": {{content}}}[/TOOL_RESULTS]', "[TOOL_CALLS]{{content}}<eos>", BOS, tools="mistral", fused=True),
    Template("pixtral", "[INST]{{content}}[/INST]", "{{content}}<eos>", "{{content}}\n\n", '[TOOL_RESULTS]{"content": {{content}}}[/TOOL_RESULTS]', "[TOOL_CALLS]{{content}}<eos>", BOS, tools="mistral", fused=True),
    Template("mistral", "[INST] {{content}}[/INST]", " {{content}}<eos>", "{{content}}\n\n", '[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]', "[TOOL_CALLS] {{content}}<eos>", BOS, tools="mistral", fused=True),
    Template("llava_next_mistral", "[INST] {{content}}[/INST]", " {{content}}<eos>", "{{content}}\n\n", '[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]', "[TOOL_CALLS] {{content}}<eos>", BOS, tools="mistral", fused=True),
    Template("llava_next_video_mistral", "[INST] {{content}}[/INST]", " {{content}}<eos>", "{{content}}\n\n", '[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]', "[TOOL_CALLS] {{content}}<eos>", BOS, tools="mistral", fused=True),
):
    register(_t)
for _copy, _of, _more in (
    ("mllama", "llama3", {}),
    ("llava_next_llama3", "llama3", {}),
    ("skywork_o1", "llama3", {"default_system": "You are Skywork-o1, a thinking model developed by Skywork AI, specializing in solving complex problems involving mathematics, coding, and logical reasoning through deep thought. When faced with a user's request, you first engage in a lengthy and in-depth thinking process to explore possible solutions to the problem. After completing your thoughts, you then provide a detailed explanation of the solution process in your response."}),
    ("moonlight", "kimi_vl", {"default_system": "You are a helpful assistant provided by Moonshot-AI.", "reasoning": False, "thought": ("<think>", "</think>")}),
):
    register(replace(TEMPLATES[_of], name=_copy, **_more))
for _t in (
    Template("codegeex4", "<|user|>\n{{content}}<|assistant|>\n", "{{content}}", "<|system|>\n{{content}}", "<|observation|>\n{{content}}<|assistant|>\n", "{{content}}", "[gMASK]<sop>", "你是一位智能编程助手，你叫CodeGeeX。你会为用户回答关于编程、代码、计算机方面的任何问题，并提供格式规范、可以执行、准确安全的代码，并在必要时提供详细的解释。", "glm4"),
    Template("deepseekcoder", "### Instruction:\n{{content}}\n### Response:", "\n{{content}}\n<|EOT|>\n", prefix=BOS, default_system="You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n"),
    Template("granite3_vision", "<|user|>\n{{content}}\n<|assistant|>\n", system="<|system|>\n{{content}}\n", default_system=_CURIOUS),
    Template("intern", "<|User|>:{{content}}\n<|Bot|>:", "{{content}}<eoa>\n", "<|System|>:{{content}}\n", prefix=BOS, default_system=_INTERN),
    Template("llama4", "<|header_start|>user<|header_end|>\n\n{{content}}<|eot|><|header_start|>assistant<|header_end|>\n\n", "{{content}}<|eot|>", "<|header_start|>system<|header_end|>\n\n{{content}}<|eot|>", "<|header_start|>ipython<|header_end|>\n\n{{content}}<|eot|><|header_start|>assistant<|header_end|>\n\n", "{{content}}<|eot|>", BOS, tools="llama3"),
    Template("mistral_small", "[INST]{{content}}[/INST]", system="[SYSTEM_PROMPT]{{content}}[/SYSTEM_PROMPT]", observation='[TOOL_RESULTS]{"content": {{content}}}[/TOOL_RESULTS]', function="[TOOL_CALLS]{{content}}<eos>", prefix=BOS, tools="mistral"),
    Template("olmo", "<|user|>\n{{content}}<|assistant|>\n", prefix=EOS),
    Template("openchat", "GPT4 Correct User: {{content}}<eos>GPT4 Correct Assistant:", prefix=BOS),
    Template("openchat-3.6", "<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n", prefix=BOS),
    Template("orion", "Human: {{content}}\n\nAssistant: <eos>", prefix=BOS),
    Template("paligemma", "{{content}}\n", prefix=BOS, fused=True),
    Template("paligemma_chat", "<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n", "{{content}}<end_of_turn>\n", observation="<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n", prefix=BOS, fused=True),
    Template("phi", "<|user|>\n{{content}}<|end|>\n<|assistant|>\n", "{{content}}<|end|>\n", "<|system|>\n{{content}}<|end|>\n"),
    Template("phi_small", "<|user|>\n{{content}}<|end|>\n<|assistant|>\n", "{{content}}<|end|>\n", "<|system|>\n{{content}}<|end|>\n"),  # its prefix is a set of neither special token, which gives nothing
    Template("phi4", "<|im_start|>user<|im_sep|>{{content}}<|im_end|><|im_start|>assistant<|im_sep|>", "{{content}}<|im_end|>", "<|im_start|>system<|im_sep|>{{content}}<|im_end|>"),
    Template("sailor", "<|im_start|>question\n{{content}}<|im_end|>\n<|im_start|>answer\n", "{{content}}<|im_end|>\n", "<|im_start|>system\n{{content}}<|im_end|>\n", default_system="You are an AI assistant named Sailor created by Sea AI Lab. Your answer should be friendly, unbiased, faithful, informative and detailed."),
    Template("seed_coder", "<bos>user\n{{content}}<eos><bos>assistant\n", system="<bos>system\n{{content}}<eos>", default_system="You are an AI programming assistant, utilizing the Seed-Coder model, developed by ByteDance Seed, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n\n"),
    Template("solar", "### User:\n{{content}}\n\n### Assistant:\n", "{{content}}", "### System:\n{{content}}\n\n"),
    Template("starchat", "<|user|>\n{{content}}<|end|>\n<|assistant|>", "{{content}}<|end|>\n", "<|system|>\n{{content}}<|end|>\n"),
    Template("telechat", "<_user>{{content}}<_bot>", system="<_system>{{content}}<_end>"),
    Template("telechat2", "<_user>{{content}}<_bot>", system="<_system>{{content}}", default_system="你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。"),
    Template("xuanyuan", "Human: {{content}} Assistant:", default_system="以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、不安全、有争议、政治敏感等相关的话题、问题和指示。\n"),
    Template("xverse", "Human: {{content}}\n\nAssistant: "),
    Template("yayi", "<|Human|>:\n{{content}}\n\n<|YaYi|>:", "{{content}}\n\n", "<|System|>:\n{{content}}\n\n", default_system="You are a helpful, respectful and honest assistant named YaYi developed by Beijing Wenge Technology Co.,Ltd. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."),
    Template("yi_vl", "### Human: {{content}}\n### Assistant:", "{{content}}\n", default_system="This is a chat between an inquisitive human and an AI assistant. Assume the role of the AI assistant. Read all the images carefully, and respond to the human's questions with informative, helpful, detailed and polite answers. 这是一个好奇的人类和一个人工智能助手之间的对话。假设你扮演这个AI助手的角色。仔细阅读所有的图像，并对人类的问题做出信息丰富、有帮助、详细的和礼貌的回答。\n\n"),
    Template("yuan", "{{content}}<sep>", "{{content}}<eod>\n"),
    Template("zephyr", "<|user|>\n{{content}}<eos><|assistant|>\n", system="<|system|>\n{{content}}<eos>", default_system="You are Zephyr, a helpful assistant."),
    Template("ziya", "<human>:{{content}}\n<bot>:", "{{content}}\n"),
):
    register(_t)


# Texts at which generation stops, by template.
STOPS = {
    "aquila": ("</s>",),
    "bailing": ("<|endoftext|>",),
    "chatglm3": ("<|user|>", "<|observation|>"),
    "chatml": ("<|im_end|>", "<|im_start|>"),
    "chatml_de": ("<|im_end|>", "<|im_start|>"),
    "codegeex4": ("<|user|>", "<|observation|>"),
    "falcon_h1": ("<|im_end|>", "<|end_of_text|>"),
    "gemma": ("<end_of_turn>",),
    "gemma3": ("<end_of_turn>",),
    "glm4": ("<|user|>", "<|observation|>"),
    "glmz1": ("<|user|>", "<|observation|>"),
    "hunyuan": ("<|eos|>",),
    "intern": ("<eoa>",),
    "llama3": ("<|eot_id|>", "<|eom_id|>"),
    "llama4": ("<|eot|>", "<|eom|>"),
    "llava_next_llama3": ("<|eot_id|>", "<|eom_id|>"),
    "mllama": ("<|eot_id|>", "<|eom_id|>"),
    "openchat-3.6": ("<|eot_id|>",),
    "paligemma_chat": ("<end_of_turn>",),
    "phi": ("<|end|>",),
    "phi_small": ("<|end|>",),
    "skywork_o1": ("<|eot_id|>", "<|eom_id|>"),
    "starchat": ("<|end|>",),
    "yayi": ("<|End|>",),
    "yi_vl": ("###",),
    "yuan": ("<eod>",),
}
_IM_END = (
    "cpm3", "cpm4", "dbrx", "intern2", "intern_vl", "kimi_vl", "llava_next_qwen", "llava_next_video_yi", "llava_next_yi", "marco", "mimo", "mimo_vl", "minicpm_o", "minicpm_v",
    "moonlight", "opencoder", "phi4", "qwen", "qwen2_audio", "qwen2_omni", "qwen2_vl", "qwen3", "sailor", "smollm", "smollm2", "yi",
)
STOPS |= {name: ("<|im_end|>",) for name in _IM_END}
# Templates whose answers are closed once, at the end of a conversation; and those whose first stop text becomes the end token.
EFFICIENT = ("baichuan", "baichuan2", "bailing", "breeze", "chatglm2", "chatglm3", "codegeex4", "falcon", "fewshot", "glm4", "glmz1", "index", "solar", "yi_vl")
REPLACED = (
    "chatml", "chatml_de", "dbrx", "gemma", "gemma3", "llama3", "llama4", "llava_next_llama3", "llava_next_qwen", "mimo", "mimo_vl", "mllama", "moonlight", "paligemma_chat",
    "phi", "phi4", "phi_small", "qwen", "qwen2_audio", "qwen2_omni", "qwen2_vl", "qwen3",
)


def end_tokens(t: Template, eos: str) -> tuple[str, list[str]]:
    """The end token and the further stop texts: of a template in ``REPLACED`` the first stop text takes the place of ``eos``."""
    stops = list(STOPS.get(t.name, ()))
    if t.name in REPLACED and stops:
        return stops[0], stops[1:]
    return eos, stops


def to_modelfile(t: Template, bos: str, eos: str, stops: tuple[str, ...] = (), context: int = 4096) -> str:
    """The template as a model file with Go template text, for a local model runner."""

    def shown(slot: str, name: str) -> str:
        return slot.replace(BOS, bos).replace(EOS, eos).replace("{{content}}", "{{ " + name + " }}", 1)

    body = [shown(t.prefix, ""), "{{ if .System }}", shown(t.system, ".System"), "{{ end }}{{ range .Messages }}"]
    body += ['{{ if eq .Role "user" }}', shown(t.user, ".Content"), '{{ else if eq .Role "assistant" }}', shown(t.assistant, ".Content"), "{{ end }}{{ end }}"]
    parts = ["FROM .", f'TEMPLATE """{"".join(body)}"""', *([f'SYSTEM """{t.default_system}"""'] if t.default_system else [])]
    return "\n\n".join(parts) + "\n\n" + "".join(f'PARAMETER stop "{s}"\n' for s in dict.fromkeys((eos, *stops))) + f"PARAMETER num_ctx {context}\n"


def infer_template(name: str, apply: Callable[[list[dict[str, str]], bool], str], prefix: str = "") -> Template:
    """A template from what a tokenizer's own makes of marked turns.

    apply(turns, ask) gives the text of turns, with the beginning of an answer if ``ask``. A system text that
    is there without being given is the default.
    """
    mark = "\x00content\x00"
    text = lambda ask, *turns: apply([{"role": r, "content": mark} for r in turns], ask)[len(prefix) :]
    slot = lambda s: s.replace(mark, "{{content}}")
    system, user = text(False, "system"), text(True, "user")
    head, _, tail = system.partition(mark)
    answer = text(False, "user", "assistant")[len(user) :]
    before = user[: user.index(mark)]
    default = ""
    alone = text(True, "system", "user")[len(system) :]  # the user's turn after a system text that was given
    if len(user) > len(alone) and user.endswith(alone):
        default = before[len(head) : len(user) - len(alone) - len(tail)]
        user = alone
    reasoning = "<think>" in answer
    answer = answer.replace("<think>", "").replace("</think>", "").lstrip("\n")
    return Template(name, slot(user), slot(answer), slot(system), prefix=prefix, default_system=default, reasoning=reasoning)
