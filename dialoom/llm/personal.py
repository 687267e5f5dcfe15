"""Personal information inside free text (problem 7).

Method: bootstrapped contextual extraction. Candidates of all five types are cut out with the characters around
them; (left, right) is a pattern, the candidate an instance. Seeds are the strict shapes (mail addresses, numbers with
a valid birth date, dialling codes, street numbers) and, for names, what stands in a few given introductions; the
looser forms of every type (mail addresses with other signs, numbers of other lengths and groupings, clauses with a
numbered place) are instances without a score of their own. Spark then scores the pattern-instance graph in rounds: a
pattern is as good as its distinct instances, an instance as good as its patterns (noisy-or) and its parts (given-name
characters or words seen in seeds). Patterns above ``min_confidence`` then find identifiers that no seed shape or list
covers. An exact check of each type's form follows.

Names that begin with a common surname are instances wherever they stand. Whatever else fills a whole short clause
after a pattern's left side (two to four ideographs) is counted beside them: where names with a listed surname make up
``min_purity`` of a pattern's fillings, any filling is a name, whatever its surname.

Patterns need ``min_support`` distinct instances, at every size of the corpus. Of those above ``min_confidence`` the
best ``max_patterns`` (by confidence, then support) are broadcast.

Behaviour at the edges
----------------------
* null, empty and blank texts hold none and stay as they are; an empty table gives an empty result;
* overlapping finds are settled by type (mail, identity number, phone, address, name), then by place;
* full-width forms, odd spaces and hidden characters are read as their plain forms, the rest of the text is kept to
  the character; texts of any length are read whole; repeated rows get equal answers; extra columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.llm.lookalikes import LOOKALIKES, RADICALS
from dialoom.session import ensure_checkpoint_dir

TYPES = ("email", "id_number", "phone", "address", "person_name")
# Common Chinese surnames, and those of two characters.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温庞殷章葛岳季俞裴柳骆祝"
COMPOUND = "欧阳|太史|端木|上官|司马|东方|独孤|南宫|万俟|闻人|夏侯|诸葛|尉迟|公羊|赫连|澹台|皇甫|宗政|濮阳|公冶|太叔|申屠|公孙|慕容|仲孙|钟离|长孙|宇文|司徒|鲜于|司空|令狐"
_HAN = "一-鿿"

EMAIL = re.compile(
    r"(?<![A-Za-z0-9._+\-])[A-Za-z0-9](?:[A-Za-z0-9._+\-]*[A-Za-z0-9])?\s?(?:@|[(\[]\s?at\s?[)\]])\s?"
    r"[A-Za-z0-9\-]+(?:\s?(?:\.|[(\[]\s?dot\s?[)\]])\s?[A-Za-z0-9\-]*[A-Za-z][A-Za-z0-9\-]*)+", re.I,
)
ID_NUMBER = re.compile(
    r"(?<![0-9A-Za-z])\d{6}([- ]?)(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\1\d{3}[\dXx](?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])[EeGg][A-Za-z]?\d{8}(?![0-9A-Za-z])|护照(?:号码?|编号)?[:： ]{0,2}[A-Za-z]{1,2}\d{7,8}(?![0-9A-Za-z])"
)
_DIGIT = "一二三四五六七八九零〇幺"
PHONE = re.compile(
    r"(?<![0-9A-Za-z])(?:(?:\+ ?86|0086|86)[- ]?)?1[3-9]\d(?:\d{8}|[- ]\d{4}[- ]\d{4})(?![0-9])"
    r"|(?<![0-9A-Za-z\-])(?:\(0\d{2,3}\)|0\d{2,3})[- ]?\d{7,8}(?:[ ,，]{0,2}(?:转|ext\.?)[ ]?\d{1,6}|-\d{1,4}(?!\d))?(?![0-9])"
    rf"|(?<![{_DIGIT}])[一幺][{_DIGIT}]{{10}}(?![{_DIGIT}])", re.I,
)
_AREA = rf"(?:[{_HAN}]{{1,5}}(?:省|自治区|市|区|县|镇|乡|州) ?){{0,5}}"
_ROAD = rf"[{_HAN}]{{1,5}}?(?:大道|大街|[东西南北中]街|[东西南北中]路|胡同|路|街|巷|弄|里|道)"
_HOME = rf"[{_HAN}]{{1,6}}?(?:小区|公寓|花园|新村|家园|大厦|苑|府|庭|村|城|院)"
_UNIT = r"\d{1,4} ?(?:号楼|栋|幢|座|单元)(?: ?\d{1,2} ?单元)?(?: ?\d{2,5}(?: ?(?:室|房|号))?)?"
_STREETS = "Road|Street|Lane|Avenue|Drive|Court|Close|Way|Boulevard|Terrace|Place|Square|Crescent|Rd|St|Ave|Blvd"
ADDRESS = re.compile(
    rf"{_AREA}{_ROAD} ?\d{{1,5}} ?号(?!线|码)(?: ?{_HOME})?(?: ?{_UNIT})?|{_AREA}{_HOME} ?{_UNIT}"
    rf"|(?<![0-9A-Za-z])\d{{1,5}}[A-Za-z]? (?:[A-Z][A-Za-z']+ ){{1,4}}(?:{_STREETS})(?![A-Za-z])\.?(?:, ?(?:Flat|Apt\.?|Unit|Suite|Room) ?[0-9A-Za-z]+)?"
    rf"|(?<![0-9A-Za-z])\d{{1,5}}[A-Z]? (?:[A-Z']+ ){{1,4}}(?:{_STREETS.upper()})(?![A-Za-z])\.?(?:, ?(?:FLAT|APT\.?|UNIT|SUITE|ROOM) ?[0-9A-Z]+)?"
)
#: Words that lead to an address and are none of it.
LEAD = re.compile(rf"^[{_HAN}]{{0,4}}?(?:家住|住在|单位在|地址写|址写|址还是|地址是|址是|址在|还是|寄到|送到|寄往|送往|放在|放到|放|住|写|在)(?=[{_HAN}]{{2}})")
#: Numbers that stand after these are none of a person's.
NOT_PERSONAL = re.compile(r"(?:订单|单号|流水号?|编号|学号|工号|题号|货号|发票号|验证码)(?:是|为)?[:： ]{0,2}$")
HAN_NAME = re.compile(rf"(?=((?:{COMPOUND})[{_HAN}]{{1,2}}|[{SURNAMES}][{_HAN}]{{1,2}}))")
LATIN_NAME = re.compile(r"(?<![A-Za-z])[A-Z][A-Za-z'’\-]+ [A-Z][A-Za-z'’\-]+(?![A-Za-z])")
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z.:\-])(?!\d{4}-\d\d-\d\d)\+?\d(?:[\d \-]{5,16})\d(?![0-9A-Za-z%:])")
#: Looser forms of the other types: any sign between name and host, other lengths, a numbered place in a clause.
LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._+\-])[A-Za-z0-9][A-Za-z0-9._+\-]* ?(?:[@#]|艾特|圈[aA]|(?<= )at(?= )) ?[A-Za-z0-9\-]+(?: ?(?:\.|点|(?<= )dot(?= )) ?[A-Za-z0-9\-]+)+", re.I)
LOOSE_ID = re.compile(r"(?<![0-9A-Za-z.:\-])(?:\d(?:[- ]?\d){13,16}[- ]?[\dXx]|[A-Za-z]{1,2}\d{7,9})(?![0-9A-Za-z%:])")
_PLACE = rf"(?=[^\n]*?\d)[{_HAN}]{{2,}}[{_HAN}0-9A-Za-z\- ]*?\d+ ?(?:号|栋|幢|座|单元|室|楼|层|弄|巷|期|房)[{_HAN}0-9A-Za-z\- ]*"
_CLAUSE_END = r"(?=[\s，。！？；、,.!?;:：/\\|\"'“”‘’()（）\[\]【】<>《》「」{}…~～@]|$)"
_CLAUSE_START = r"(?:(?<=[\s，。！？；、,.!?;:：/\\|\"'“”‘’()（）\[\]【】<>《》「」{}…~～@-])|^)"
LOOSE_ADDRESS = re.compile(rf"{_CLAUSE_START}(?={_PLACE}{_CLAUSE_END})([{_HAN}]+[{_HAN}0-9A-Za-z\- ]*)")
#: A clause that may be an introduction and a name.
FILLED = re.compile(rf"{_CLAUSE_START}([{_HAN}]{{3,8}}){_CLAUSE_END}")
#: What no name holds.
NO_NAME = re.compile("什么|老师|同学|先生|女士|小姐|经理|主任|名字|[我你您他她它谁啥哪怎这那的了吗呢吧啊是不没有在和就都也还很]")
#: Introductions whose contents are the first names known: (left, right), right "P" for a boundary.
SEED_PATTERNS = (("^我叫", "P"), ("^姓名：", "P"), ("name is ", "P"), ("^联系人是", "P"), ("^收件人", "P"))
NAMES = ("person_name", "filling")
TITLES = re.compile(r"^(?:老师|同学|先生|女士|小姐|经理|主任|教授|医生|总|哥|姐|叔|阿姨)")
_BOUNDARY = re.compile(r"[\s，。！？；、,.!?;:：/\\|\"'“”‘’()（）\[\]【】<>《》「」{}…~@-]")
_ODD = re.compile(
    "[\u00a0\u00ad\u0300-\u036f\u0370-\u04ff\u0500-\u052f\u1680\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u2000-\u200f\u202a-\u202f\u205f-\u2064\u2066-\u206f\u20d0-\u20ff\u2e80-\u2fd5\u3000"
    "\ufe00-\ufe0f\ufe20-\ufe2f\ufeff\uff02-\uff07\uff0a\uff0b\uff0d-\uff19\uff1c-\uff1e\uff20-\uff5e]"
)


@lru_cache(maxsize=1 << 12)
def _plain(ch: str) -> str:
    """The plain form of an odd character; nothing for what can't be seen and for separate accents."""
    o = ord(ch)
    if 0xFF02 <= o <= 0xFF5E:
        return chr(o - 0xFEE0)
    if o in (0xA0, 0x1680, 0x202F, 0x205F, 0x3000) or 0x2000 <= o <= 0x200A:
        return " "
    if 0x370 <= o <= 0x52F:
        return LOOKALIKES.get(ch, ch)
    return RADICALS.get(ch) or unicodedata.normalize("NFKC", ch) if 0x2E80 <= o <= 0x2FD5 else ""


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text in plain forms, and for each of its characters the place in the original (None: the same).

    Full-width signs that Chinese text is punctuated with stay. The written line breaks of a JSON text are read as line
    breaks (of the same length).
    """
    text = text.replace("\\n", "\n\n")
    if not _ODD.search(text):
        return text, None
    out, at, last = [], [], 0
    for m in _ODD.finditer(text):
        i = m.start()
        out.append(text[last:i])
        at.extend(range(last, i))
        plain = _plain(m[0])
        out.append(plain)
        at.extend([i] * len(plain))
        last = i + 1
    out.append(text[last:])
    at.extend(range(last, len(text) + 1))
    return "".join(out), at


@lru_cache(maxsize=1 << 17)
def _left(near: str) -> str:
    tail = near[-5:]
    for i in range(len(tail) - 2, -1, -1):
        if _BOUNDARY.match(tail[i]):
            return re.sub(r"\d", "0", "^" + tail[i + 1 :][-4:])
    return re.sub(r"\d", "0", tail[-4:] if len(near) > 4 else "^" + tail)


def left_of(text: str, start: int) -> str:
    """Up to four characters before a candidate, from the last boundary on; two words for Latin script."""
    near = text[max(0, start - 5) : start]
    if near[-1:] == " " and near[-2:-1].isascii() and (m := re.search(r"[A-Za-z]+ [A-Za-z]+ $", text[max(0, start - 24) : start])):
        return m[0].lower()
    return _left(near)


@lru_cache(maxsize=1 << 17)
def _right(near: str) -> str:
    return "P" if not near or _BOUNDARY.match(near[0]) or near[0] == "\u00a4" else re.sub(r"\d", "0", near)


def right_of(text: str, end: int) -> str:
    return _right(text[end : end + 2])


_AT_SIGN = re.compile(r"@|[(\[] ?at ?[)\]]", re.I)
_ANY_AT = re.compile(r"[@#]|艾特|圈a| at ", re.I)
_SEVEN = re.compile(rf"\d(?:[^\d]{{0,2}}\d){{6}}|[一幺][{_DIGIT}]{{10}}")
_NUMBERED = re.compile(r"\d ?[号栋幢座单]|\d[A-Za-z]? [A-Z][A-Za-z']+ [A-Z]")
_PLACED = re.compile(r"\d ?[号栋幢座单室楼层弄巷期房]")


def strict(text: str) -> list[tuple[int, int, str]]:
    """Spans of the strict shapes, without overlaps, mail addresses first."""
    taken: list[tuple[int, int, str]] = []

    def add(pattern: re.Pattern, kind: str) -> None:
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind in ("phone", "id_number") and NOT_PERSONAL.search(text, max(0, a - 12), a):
                continue
            if kind == "address" and (lead := LEAD.match(text[a:b])):
                a += lead.end()
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))

    # Each shape is looked for only where something that it can't do without occurs.
    if _AT_SIGN.search(text):
        add(EMAIL, "email")
    if _SEVEN.search(text):
        add(ID_NUMBER, "id_number")
        add(PHONE, "phone")
    elif "护照" in text:
        add(ID_NUMBER, "id_number")
    if _NUMBERED.search(text):
        add(ADDRESS, "address")
    return taken


def candidates(text: str, taken: list[tuple[int, int, str]], lefts: set | None = None) -> Iterator[tuple[str, int, int, str, str]]:
    """(type, start, end, left, right) of everything that may be a name, or personal data in a looser form.

    Type ``filling`` is what fills a short clause after its first characters, with any first ideograph. ``lefts`` are
    the (type, left) that any pattern has: what stands elsewhere needn't be cut out.
    """
    inside = lambda a, b: any(a < y and b > x for x, y, _ in taken)
    for m in HAN_NAME.finditer(text):
        a, full = m.start(), m[1]
        left = left_of(text, a)
        if lefts is not None and ("person_name", left) not in lefts:
            continue
        for n in range(3 if full[:2] in _COMPOUND_SET else 2, len(full) + 1):
            if not inside(a, a + n):
                yield "person_name", a, a + n, left, right_of(text, a + n)
    for m in FILLED.finditer(text):
        a, b = m.span()
        for start in range(max(a + 1, b - 4), min(a + 4, b - 2) + 1):
            left = "^" + text[a:start]
            if (lefts is None or ("filling", left) in lefts) and not inside(start, b) and not NO_NAME.search(text, start, b):
                yield "filling", start, b, left, "P"
    others = [("person_name", m) for m in LATIN_NAME.finditer(text)]
    if _SEVEN.search(text):
        others += [("phone", m) for m in LOOSE_PHONE.finditer(text) if 7 <= len(_DIGITS.findall(m[0])) <= 13]
        others += [("id_number", m) for m in LOOSE_ID.finditer(text)]
    if _ANY_AT.search(text):
        others += [("email", m) for m in LOOSE_EMAIL.finditer(text)]
    for kind, m in others:
        if not inside(*m.span()):
            yield kind, m.start(), m.end(), left_of(text, m.start()), right_of(text, m.end())
    if _PLACED.search(text):
        for m in LOOSE_ADDRESS.finditer(text):
            a, b = m.span()
            b = a + len(text[a:b].rstrip())
            for start in range(a + 1, min(a + 4, b - 5) + 1):
                if not inside(start, b):
                    yield "address", start, b, left_of(text, start), right_of(text, b)


_DIGITS = re.compile(r"\d")
_COMPOUND_SET = frozenset(COMPOUND.split("|"))
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "left", "right", "instance")] + [T.StructField("seed", T.BooleanType())])
PATTERN = ("kind", "left", "right")


def edges(texts: DataFrame) -> DataFrame:
    """Distinct (kind, left, right, instance, seed) of column ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for text in batch["text"].unique():
                if not isinstance(text, str) or not text:
                    continue
                plain, _ = fold(text)
                taken = strict(plain)
                for a, b, kind in taken:
                    rows.add((kind, left_of(plain, a), right_of(plain, b), plain[a:b], True))
                for kind, a, b, left, right in candidates(plain, taken):
                    rows.add((kind, left, right, plain[a:b], kind == "person_name" and (left, right) in SEED_PATTERNS))
            yield pd.DataFrame(list(rows), columns=EDGE.names)

    return texts.select("text").mapInPandas(run, EDGE).groupBy(*PATTERN, "instance").agg(F.max("seed").alias("seed"))


def induce(
    texts: DataFrame, rounds: int = 3, min_confidence: float = 0.4, min_support: int = 3, min_purity: float = 0.6, max_patterns: int = 1_000_000
) -> dict[tuple[str, str, str], float]:
    """High-confidence patterns (kind, left, right) with their confidence, learned from column ``text``."""
    ensure_checkpoint_dir(texts.sparkSession)
    # The graph itself is of hashes; names of patterns and instances stay in their own tables.
    named = edges(texts).select(*PATTERN, "instance", "seed", F.xxhash64(*PATTERN).alias("p"), F.xxhash64("kind", "instance").alias("i")).checkpoint()
    # Patterns with too few distinct instances can't be kept; leaving them out first keeps the graph small.
    support = named.groupBy("p").agg(*[F.first(c).alias(c) for c in PATTERN], F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support).checkpoint()
    whole = named.join(support.select("p"), "p")
    graph = whole.filter(F.col("kind") != "filling").select("p", "i", "kind", "instance", "seed").checkpoint()
    nodes = graph.groupBy("i").agg(F.first("kind").alias("kind"), F.first("instance").alias("instance"), F.max("seed").alias("seed"))
    graph = graph.select("p", "i")
    parts = nodes.withColumn(
        "part", F.explode(F.when(F.col("instance").contains(" "), F.split("instance", " ")).otherwise(F.split(F.substring("instance", 2, 9), "")))
    ).filter((F.col("kind") == "person_name") & (F.col("part") != ""))
    known = parts.filter("seed").groupBy("part").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("part", F.lit(1.0).alias("known"))
    prior = parts.join(known, "part", "left").groupBy("i").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("prior"))
    start = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("prior", F.lit(0.0)) * 0.5)
    base = nodes.join(prior, "i", "left").select("i", "seed", F.coalesce("prior", F.lit(0.0)).alias("prior"), start.alias("score")).checkpoint()
    scores, confidence = base.select("i", "score"), None
    for _ in range(rounds):
        confidence = graph.join(scores, "i").groupBy("p").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
        confidence = confidence.select("p", (F.col("mean") * F.col("n") / (F.col("n") + 1)).alias("confidence")).checkpoint()
        reach = graph.join(confidence, "p").groupBy("i").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))).alias("reach"))
        rated = F.when(F.col("seed"), 1.0).otherwise(F.col("prior") * F.greatest(F.lit(0.5), F.col("reach")))
        scores = base.join(reach, "i").select("i", rated.alias("score"))
    told = F.length(F.regexp_replace("left", r"[\^\s\p{P}0-9]", "")) > 0  # a boundary alone says nothing
    kept = confidence.join(support, "p").filter((F.col("confidence") >= min_confidence) & told).select(*PATTERN, "confidence", "n")
    # Of the fillings of a name pattern, those that begin with a listed surname.
    listed = F.avg(F.col("instance").rlike(f"^(?:{COMPOUND}|[{SURNAMES}])").cast("double"))
    pure = whole.filter(F.col("kind") == "filling").groupBy("left", "right").agg(listed.alias("purity"), F.count(F.lit(1)).alias("fillings")).filter(F.col("purity") >= min_purity)
    free = kept.filter(F.col("kind") == "person_name").join(pure, ["left", "right"]).select(F.lit("filling").alias("kind"), "left", "right", (F.col("confidence") * F.col("purity")).alias("confidence"), F.col("fillings").alias("n"))
    best = kept.unionByName(free).orderBy(F.desc("confidence"), F.desc("n"), *PATTERN).limit(max_patterns).collect()
    return {(r.kind, r.left, r.right): r.confidence for r in best}


def find(text: str, patterns: dict[tuple[str, str, str], float], lefts: set | None = None) -> list[tuple[int, int, str]]:
    """Spans of personal data in a plain text, in order."""
    taken = strict(text)
    best: dict[int, tuple[float, int, str]] = {}
    for kind, a, b, left, right in candidates(text, taken, lefts):
        confidence = patterns.get((kind, left, right), 1.0 if kind in NAMES and (left, right) in SEED_PATTERNS else 0.0)
        if not confidence:
            continue
        kind = "person_name" if kind == "filling" else kind
        if kind == "person_name" and TITLES.match(text[b:]) or (kind in ("phone", "id_number") and NOT_PERSONAL.search(text, max(0, a - 12), a)):
            continue
        if a not in best or (confidence, b) > best[a][:2]:
            best[a] = (confidence, b, kind)
    for a, (_, b, kind) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, kind))
    return sorted(taken)


def known_lefts(patterns: dict) -> set[tuple[str, str]]:
    return {(kind, left) for kind, left, _ in patterns} | {(kind, left) for kind in NAMES for left, _ in SEED_PATTERNS}


def mask(text: str, patterns: dict, lefts: set | None = None) -> tuple[str, list[str]]:
    """The text with typed placeholders, everything else to the character, and the sorted types."""
    plain, at = fold(text)
    spans = find(plain, patterns, lefts)
    if not spans:
        return text, []
    out, last = [], 0
    for a, b, kind in spans:
        x, y = (a, b) if at is None else (at[a], at[b - 1] + 1)
        out += [text[last:x], f"<{kind}>"]
        last = y
    return "".join([*out, text[last:]]), sorted({k for _, _, k in spans})


def redact(df: DataFrame, text_col: str, patterns: dict, out_col: str = "redacted", types_col: str = "pii_types") -> DataFrame:
    """Add the text with placeholders and the types found."""
    shared = df.sparkSession.sparkContext.broadcast(patterns)

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("types", T.ArrayType(T.StringType()))]))
    def run(texts: pd.Series) -> pd.DataFrame:
        lefts = known_lefts(shared.value)
        place, once = pd.factorize(texts)
        done = [mask(t, shared.value, lefts) for t in once]
        got = [done[i] if i >= 0 else (None, []) for i in place]
        return pd.DataFrame({"text": [g[0] for g in got], "types": [g[1] for g in got]})

    return df.withColumn("__redact", run(text_col)).withColumns({out_col: F.col("__redact.text"), types_col: F.col("__redact.types")}).drop("__redact")
