"""Three question detectors and the message classes; each keeps its own rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.blank import is_blank, strip

# Signs of a question, in the first and in the second dialect, and particles at the end in the second.
SIGNS_QUOTED = (
    "？", "?", "什么", "怎么", "如何", "为什么", "哪个", "哪里", "哪些", "谁", "何时", "多少", "啥", "咋", "咋样", "怎样", "几", "多久", "多长",
    "是什么", "是谁", "是哪", "怎么样", "好吗", "行吗", "可以吗", "不是吗", "对吗", "吗", "呢", "不", "吧",
)
SIGNS_LOOSE = (
    "？", "?", "什么", "怎么", "如何", "为什么", "哪个", "哪里", "哪些", "谁", "何时", "多少", "啥", "咋", "咋样", "怎样", "几", "多久", "多长",
    "是什么", "是谁", "是哪", "怎么样", "如何", "吗", "呢", "不是吗", "对吗", "好吗", "行吗", "可以吗",
)
AT_END = ("吗", "呢", "不", "吧")
QUOTE_RULE = "- - - - - - - - - - - - - - -"
# Fixed values of the third dialect.
ENDINGS = r"(?:吗|嘛|么|呢|吧|对吗|对吧|好不好|要不要|行不行|是不是|可不可以|能不能|行吗|行么|行嘛|好吗|好么|好嘛)$"
OPENINGS = r"^(?:能否|是否|可否|能不能|什么|怎么|怎样|为何|为什么|哪个|哪种|哪些|哪里|哪儿|哪家|哪位|谁|何时|几时|多少|多久|多长|多远|多大|多高|多重|几岁|几天|几月|几号)"
COMBINED = r"可不可以|能不能|要不要|好不好|行不行|(?:能否|是否|可否)[^。！？]*?(?:吗|呢|吧|\?|？)"


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(w.replace("?", r"\?") for w in words)


def is_question_quoted(c: Column) -> Column:
    """First dialect: what follows the last quotation rule, if longer than one character, holds any sign."""
    tail = strip(F.element_at(F.split(c, QUOTE_RULE), -1))
    return ~is_blank(c) & (F.length(tail) > 1) & tail.rlike(_any_of(SIGNS_QUOTED))


def is_question_loose(c: Column) -> Column:
    """Second dialect: longer than one character and a sign anywhere, or a particle at the end."""
    s = strip(F.coalesce(c, F.lit("")))
    return (F.length(s) > 1) & (s.rlike(_any_of(SIGNS_LOOSE)) | s.rlike(f"(?:{_any_of(AT_END)})$"))


def is_question_anchored(c: Column) -> Column:
    """Third dialect: signs at the places where questions have them."""
    s = strip(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(s, r"[。．.…!！；;,\s]+$", "")
    return s.rlike(r"[?？]") | bare.rlike(ENDINGS) | bare.rlike(OPENINGS) | s.rlike(COMBINED) | (s.contains("请问") & s.rlike("可以|能|可否|是否"))


def message_class(text: Column, question: Column) -> Column:
    """The first class whose words a message holds."""
    t = F.lower(F.coalesce(text, F.lit("nan")))
    return (
        F.when(t.rlike("好|可以|是的|ok|收到"), "确认回复").when(t.rlike("不|没"), "拒绝回复").when(question, "疑问询问")
        .when(t.rlike("谢谢|感谢|辛苦"), "感谢表达").when(F.length(t) > 50, "详细描述").when(t.rlike("了解|明白|清楚|知道"), "理解确认").otherwise("其他回复")
    )


def only_media(messages: Column) -> Column:
    """Whether every non-blank message of a non-empty array is a media token."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: (strip(m) == "") | strip(m).rlike("^<(?:image|voice|video|emotion)_")), F.lit(False))


def clean_questions(raw: Column, most: int = 5, longest: int = 20, banned: tuple[str, ...] = ()) -> Column:
    """Questions from a model's reply: a JSON list anywhere in it, else its lines; think tags removed, a question mark
    at the end, three to ``longest`` characters, each once, in order."""
    told = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    listed = F.from_json(F.regexp_extract(told, r"(?s)\[[^\]]+\]", 0), "array<string>")
    parts = F.coalesce(listed, F.split(told, "\n"))
    mark = lambda q: F.when(q.rlike("[?？]"), q).otherwise(F.concat(q, F.lit("？")))
    cut = lambda q: F.when(F.length(q) > longest, F.concat(F.regexp_replace(F.substring(q, 1, longest), "[，,。.!？?]+$", ""), F.lit("？"))).otherwise(q)
    asked = F.transform(F.filter(F.transform(parts, strip), lambda q: q != ""), lambda q: cut(mark(q)))
    kept = F.filter(asked, lambda q: F.length(q) >= 3)
    if banned:
        kept = F.filter(kept, lambda q: ~q.rlike("|".join(banned)))
    return F.slice(F.array_distinct(kept), 1, most)
