"""Visually identical text with different characters (problem 5).

Method: a trie of the corpus's own clean words is walked by a weighted edit automaton. Each unit of a token (a
character with the accents and hidden characters after it) may be read as itself, as its look-alike, its plain or its
composed form at no cost; any other letter, a letter more or a letter less costs one each, which the limit of
``MAX_COST`` (zero) rules out. Of the words reached at the end of a token the cheapest and then most frequent spelling
is taken, and the kinds of the zero-cost edits on the way to it are the oddities of the token: a row is found by the
edits that its tokens took. Tokens that reach no word, and everything between tokens, are normalised by table (the same
zero-cost relation without a vocabulary), with the kinds of the substitutions made.

The vocabulary is counted over all texts. Words of at least ``min_share`` of all word occurrences are kept, so
the trie has at most ``1 / min_share`` words whatever the size of the corpus; a rarer word is normalised by table.

Behaviour at the edges
----------------------
* null stays null with no kinds; empty and blank texts stay as they are but for odd spaces;
* an emoji's own joiners, variation selectors and tags stay, ordinary Chinese punctuation stays;
* precomposed accents stay; a base letter with a separate accent becomes the precomposed letter where there is one;
* words wholly in another script stay; texts of any length are handled whole; ties of frequency go to the smaller word;
* ligatures, mathematical letters and digits and Roman numerals take their plain form, kind ``compatibility``, which is
  none of the six KINDS of oddity;
* a letter of another script that looks like no Latin one stays within its word;
* the given columns are added under the names asked for; other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters that they look like, script by script.
LOOKALIKES = dict(
    zip(
        "АВЕЗКМНОРСТУХЅІЈЬҮҺӀԌԚԜѴабвгеёзикмнопрстухѕіјһӏԁԛԝѵьүѡ"  # Cyrillic
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿανορτυικχγηωϲϳ"  # Greek
        "ՍՏՕՀԼազհյոռսցօքլ"  # Armenian
        "ᎠᎡᎢᎥᎩᎪᎫᎬᎷᎻᎽᏀᏂᏃᏎᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴᎳ"  # Cherokee
        "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲓⲟⲣⲥⲭ"  # Coptic
        "ჿႽ"  # Georgian
        "וןס"  # Hebrew
        "اه",  # Arabic
        "ABE3KMHOPCTYXSIJbYhIGQWVa6Breë3ukMHonpcTyxsijhldqwvbyw"
        "ABEZHIKMNOPTYXCJavoptuikxynwcj"
        "USOZLwqhjnnugofl"
        "DRTiyAJEMHYGhZ4bRWSVSLCPKdGBW"
        "BHIKMNOPCTYXiopcx"
        "oS"
        "llo"
        "lo",
        strict=True,
    )
)
OTHER_SCRIPTS = "CYRILLIC|GREEK|ARMENIAN|CHEROKEE|COPTIC|GEORGIAN|HEBREW|ARABIC|THAI|DEVANAGARI"
_JAVA_OTHER = r"\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}\p{IsCoptic}\p{IsGeorgian}\p{IsHebrew}\p{IsArabic}\p{IsThai}\p{IsDevanagari}"
#: Texts without any of these are already in the one form; the automaton isn't run on them.
SUSPECT = (
    r"[０-９Ａ-Ｚａ-ｚ⺀-⻳⼀-⿕ᅟᅠㅤﾠ\x{2100}-\x{2188}\x{fb00}-\x{fb06}\x{1d400}-\x{1d7ff}]|[\p{Zs}&&[^ ]]|\p{Cf}|\p{Mn}|\p{Me}"
    rf"|\p{{IsLatin}}[{_JAVA_OTHER}]|[{_JAVA_OTHER}]\p{{IsLatin}}"
)
WORD = r"[A-Za-zÀ-ÖØ-öø-ɏ]{2,}"
KINDS = ("full_width", "combining", "invisible", "space", "mixed_script", "radical")
#: What the edits of the automaton beyond the free ones cost, and the most that a token may cost.
OTHER_EDIT, MAX_COST = 1, 0
_FILLERS = "ᅟᅠㅤﾠ"


@lru_cache(maxsize=1 << 16)
def _script(ch: str) -> str:
    """L for Latin, O for a letter of another alphabet, C for any other letter, empty for no letter."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "")
    if name.startswith(("LATIN", "FULLWIDTH LATIN")):
        return "L"
    return "O" if re.match(OTHER_SCRIPTS, name) else "C"


@lru_cache(maxsize=1 << 16)
def _kind(ch: str) -> str:
    """The kind of oddity of a character by itself, or the empty string."""
    o = ord(ch)
    if o < 0xA0:
        return ""
    if 0xFF10 <= o <= 0xFF19 or 0xFF21 <= o <= 0xFF3A or 0xFF41 <= o <= 0xFF5A:
        return "full_width"
    if 0x2E80 <= o <= 0x2EF3 or 0x2F00 <= o <= 0x2FD5:
        return "radical"
    category = unicodedata.category(ch)
    if category == "Cf" or ch in _FILLERS or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o == 0x34F:
        return "invisible"
    if category == "Zs":
        return "space"
    if category in ("Lu", "Ll", "Lo", "Nl", "Nd") and unicodedata.decomposition(ch).startswith(("<font>", "<compat>")) and unicodedata.normalize("NFKC", ch).isascii():
        return "compatibility"
    if category in ("Mn", "Me") and (0x300 <= o <= 0x36F or 0x1AB0 <= o <= 0x1AFF or 0x1DC0 <= o <= 0x1DFF or 0x20D0 <= o <= 0x20FF or 0xFE20 <= o <= 0xFE2F):
        return "combining"
    return ""


# Common ideographs that the radical supplement lacks a compatibility mapping for.
RADICALS = {"⺀": "冫", "⺁": "厂", "⺄": "乙", "⺅": "亻", "⺆": "冂", "⺈": "刀", "⺉": "刂", "⺌": "小", "⺍": "小", "⺕": "彐", "⺗": "心", "⺘": "扌", "⺝": "月", "⺟": "母", "⺠": "民", "⺡": "氵", "⺣": "灬", "⺤": "爪", "⺥": "爪", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺰": "纟", "⺶": "羊", "⺷": "羊", "⺸": "羊", "⺹": "老", "⺼": "肉", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "西", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻕": "阜", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻱": "龟", "⻲": "亀", "⻳": "龟"}


def _pictorial(ch: str) -> bool:
    o = ord(ch)
    return 0x1F000 <= o <= 0x1FAFF or 0x2190 <= o <= 0x2BFF or o in (0xA9, 0xAE, 0x203C, 0x2049, 0x2122, 0x2139, 0x3030, 0x303D, 0x3297, 0x3299)


def emoji_parts(text: str) -> set[int]:
    """Places of joiners, selectors, keycap marks and tags that belong to an emoji."""
    own: set[int] = set()
    last, n = False, len(text)  # whether the character before, but for such marks, is pictorial
    for i, ch in enumerate(text):
        o = ord(ch)
        if o < 0x80:
            last = False
            continue
        if o == 0xFE0F or o == 0xFE0E:
            if last or (i and text[i - 1] in "0123456789#*" and text[i + 1 : i + 2] == "⃣"):
                own.add(i)
            continue
        if o == 0x20E3:
            if i and (text[i - 1] in "0123456789#*" or (i - 1) in own):
                own.add(i)
            last = False
            continue
        if o == 0x200D:
            if last and i + 1 < n and _pictorial(text[i + 1]):
                own.add(i)
                continue
            last = False
            continue
        if 0xE0020 <= o <= 0xE007F and last:
            own.add(i)
            continue
        last = _pictorial(ch)
    return own


@lru_cache(maxsize=1 << 16)
def _table(ch: str) -> str:
    kind = _kind(ch)
    if kind in ("full_width", "radical", "compatibility"):
        return unicodedata.normalize("NFKC", RADICALS.get(ch, ch))
    return "" if kind == "invisible" else " " if kind == "space" else ch


@lru_cache(maxsize=1 << 16)
def _readings(unit: str) -> tuple[tuple[str, frozenset[str]], ...]:
    """What a unit may be read as at no cost: (character of a word, kinds of the edits), the fewest edits first.

    A unit is a character with the separate accents and hidden characters after it.
    """
    base, marks = unit[0], "".join(c for c in unit[1:] if _kind(c) == "combining")
    edits = frozenset(filter(None, map(_kind, unit)))
    plain = _table(base)
    forms = [(plain, edits)] if len(plain) == 1 else []
    if base in LOOKALIKES:
        forms.append((LOOKALIKES[base], edits | {"mixed_script"}))
    out: dict[str, frozenset[str]] = {}
    for form, kinds in forms:
        whole = unicodedata.normalize("NFC", form + marks)
        for c in (whole, form):  # the accent composed, or left out
            if len(c) == 1:
                out.setdefault(c, kinds)
    return tuple(out.items())


def units(token: str) -> list[str]:
    """The characters of a token, each with the accents and hidden characters after it."""
    out: list[str] = []
    for ch in token:
        if out and _kind(ch) in ("combining", "invisible"):
            out[-1] += ch
        else:
            out.append(ch)
    return out


class Trie:
    """Words as nested dicts over their composed characters; the empty key holds (count, spelling)."""

    def __init__(self, words: dict[str, int]) -> None:
        self.root: dict = {}
        for word, count in words.items():
            node = self.root
            for ch in unicodedata.normalize("NFC", word):
                node = node.setdefault(ch, {})
            best = node.get("")
            if best is None or (-count, word) < (-best[0], best[1]):
                node[""] = (count, word)

    def walk(self, token: str, max_cost: int = MAX_COST) -> tuple[str, frozenset[str]] | None:
        """The cheapest, then most frequent word within ``max_cost`` of a token and the kinds of the free edits to it.

        The automaton's states are nodes of the trie with the cost and the free edits of the best way to them.
        """
        states: dict[int, tuple[int, frozenset[str], dict]] = {id(self.root): (0, frozenset(), self.root)}

        def reach(found: dict, node: dict, cost: int, kinds: frozenset[str]) -> None:
            held = found.get(id(node))
            if cost <= max_cost and (held is None or (cost, len(kinds)) < (held[0], len(held[1]))):
                found[id(node)] = (cost, kinds, node)
                if cost + OTHER_EDIT <= max_cost:  # a letter that the token lacks
                    for c, below in node.items():
                        if c:
                            reach(found, below, cost + OTHER_EDIT, kinds)

        if OTHER_EDIT <= max_cost:
            reach(start := {}, self.root, 0, frozenset())
            states = start
        for unit in units(token):
            found: dict[int, tuple[int, frozenset[str], dict]] = {}
            for cost, kinds, node in states.values():
                for c, edits in _readings(unit):
                    if c in node:
                        reach(found, node[c], cost, kinds | edits)
                if cost + OTHER_EDIT <= max_cost:
                    reach(found, node, cost + OTHER_EDIT, kinds)  # a letter too many
                    for c, below in node.items():  # another letter
                        if c:
                            reach(found, below, cost + OTHER_EDIT, kinds)
            states = found
            if not states:
                return None
        ends = [(cost, -node[""][0], node[""][1], kinds) for cost, kinds, node in states.values() if "" in node]
        return min(ends)[2:] if ends else None

    def spelling(self, token: str, max_cost: int = MAX_COST) -> str | None:
        found = self.walk(token, max_cost)
        return found and found[0]


def by_table(token: str) -> tuple[str, frozenset[str]]:
    """A token that reaches no word, character by character: its plain form and the kinds of the substitutions."""
    scripts = {_script(c) for c in token}
    kinds = set(filter(None, map(_kind, token)))
    if {"L", "O"} <= scripts:
        kinds.add("mixed_script")
    plain = "".join(LOOKALIKES.get(c, c) if "L" in scripts and _script(c) == "O" else _table(c) for c in token)
    return unicodedata.normalize("NFC", plain), frozenset(kinds)


def unify_text(text: str, trie: Trie | None) -> tuple[str, list[str]]:
    """The text in its one form, and the kinds of oddity that were in it, sorted."""
    own = emoji_parts(text)
    kinds: set[str] = set()
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        j, scripts = i, set()
        while j < n and j not in own:  # a token: letters that aren't ideographs, their accents, what hides among them
            script, kind = _script(text[j]), _kind(text[j])
            if script in ("L", "O"):
                scripts.add(script)
            elif not (scripts and kind in ("combining", "invisible")):
                break
            j += 1
        if j > i:
            token = text[i:j]
            if token.isascii() or scripts == {"O"} and not any(map(_kind, token)):
                out.append(token)
            else:
                word, edits = (trie and "L" in scripts and trie.walk(token)) or by_table(token)
                kinds |= edits
                out.append(word if edits else token)
            i = j
            continue
        kind = "" if i in own else _kind(text[i])
        if kind:
            kinds.add(kind)
            out.append(_table(text[i]))
        else:
            out.append(text[i])
        i += 1
    made = "".join(out)
    return (unicodedata.normalize("NFC", made) if "combining" in kinds else made), sorted(kinds)


def suspect(text: Column) -> Column:
    """Whether a text may be written in another than the one form (exact: others are unchanged)."""
    return text.rlike(SUSPECT)


def vocabulary(texts: DataFrame, min_share: float = 1e-4, min_count: int = 3) -> dict[str, int]:
    """Clean words of column ``text`` with their counts: at most 1 / min_share of them."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(WORD), 0)).alias("word")).groupBy("word").count().persist()
    total = words.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    kept = words.filter((F.col("count") >= min_count) & (F.col("count") >= total * min_share)).collect()
    words.unpersist()
    return {r["word"]: r["count"] for r in kept}


def unify(df: DataFrame, text_col: str, words: dict[str, int], out_col: str = "unified", kinds_col: str = "kinds") -> DataFrame:
    """Add the text in its one form and the kinds of oddities found (an empty array where there are none)."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    tries: list[Trie] = []

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))
    def walk(texts: pd.Series) -> pd.DataFrame:
        if not tries:
            tries.append(Trie(shared.value))
        got = [unify_text(t, tries[0]) if isinstance(t, str) else (None, []) for t in texts]
        return pd.DataFrame({"text": [g[0] for g in got], "kinds": [g[1] for g in got]})

    odd = F.when(suspect(F.col(text_col)), F.col(text_col))
    walked = df.withColumn("__unify", walk(odd))
    return walked.withColumns({out_col: F.coalesce(F.col("__unify.text"), F.col(text_col)), kinds_col: F.col("__unify.kinds")}).drop("__unify")
