"""Per-document text quality statistics and text types (problem 10).

Method: statistics of each text are compared with thresholds; every threshold is a noisy labelling function that
votes for one of the types prose, list, table and junk, or abstains. Expectation-maximisation on their agreements
(no labels needed) learns each function's accuracy for each type and the types' shares; the posterior of a
document's votes is its type. The votes are counted first: EM sees the distinct vote vectors, of which there are
at most the product of the functions' outcomes however many documents there are.

Behaviour at the edges
----------------------
* null, empty and blank texts have statistics of zero and no type; an empty table gives an empty result;
* a null language counts as both languages for the common words; texts of any length are read whole;
* equal texts get equal statistics; ties of the posterior go to the first type in the order above;
* extra columns pass through.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.blank import is_blank
from dialoom.session import ensure_checkpoint_dir

TYPES = ("prose", "list", "table", "junk")
#: Vote vectors that are broadcast at most; more of them are joined by shuffle.
MAX_BROADCAST = 1 << 17
_ENDS = r"[。！？；.!?;…：:”\"’)）]\s*$"


_HAN_RUN = re.compile("[\u3400-\u9fff]+")


_UNBROKEN = re.compile(r"[^A-Za-z0-9=_]+")

# Classes of characters, a bit each.
SPACE, LETTER, HAN, MARK, NUMBER, SYMBOL, STOP, STRUNG, GARBLED, ODD, BASIC, JOIN, QUOTE = (1 << i for i in range(13))
_OTHERS = {SYMBOL: "#%&*+/<=>@\\^_|~[]{}§°¤$", STOP: "。！？!?", STRUNG: "、/|,，;；", GARBLED: "\ufffd□", ODD: "jqxzJQXZ", JOIN: "'’-", QUOTE: "”\""}
#: Characters counted at once.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The classes of every character below 0x20000, and one entry for the ideographs beyond."""
    made = np.zeros(0x20001, np.uint16)
    kinds = {"L": LETTER, "M": MARK, "N": NUMBER, "S": SYMBOL}
    for o in range(0x20000):
        ch = chr(o)
        made[o] = kinds.get(unicodedata.category(ch)[0], 0) | (SPACE if ch.isspace() and not 0x1C <= o <= 0x1F else 0)
    for low, high in ((0x2E80, 0x2FD5), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAD9), (0x20000, 0x20000)):
        made[low : high + 1] |= HAN
    made[0x20000] |= LETTER
    made[0x80:0x100] |= GARBLED
    for bit, chars in _OTHERS.items():
        for ch in chars:
            made[ord(ch)] |= bit
    for letters in (range(65, 91), range(97, 123)):
        made[letters.start : letters.stop] |= BASIC
    return made


COUNTS = ("chars", "word_chars", "words", "symbols", "han", "digits", "strung", "garbled", "stops", "odd", "basic")


def count_classes(texts: list[str]) -> np.ndarray:
    """COUNTS of each text, all texts at once: no loop over characters."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros((len(texts), len(COUNTS)), np.int64)
    kind = _classes()[np.minimum(codes, 0x20000)]
    edge = np.zeros(len(codes) + 1, bool)
    edge[starts] = edge[ends] = True
    first, last = edge[:-1], edge[1:]

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[ends] - total[starts]

    def begins(mask: np.ndarray) -> np.ndarray:
        return mask & (~np.concatenate([[False], mask[:-1]]) | first)

    has = lambda bits: (kind & bits) != 0
    han = has(HAN)
    letter, number = has(LETTER) & ~han, has(NUMBER) & ~han
    # A word is a run of letters, accents and joints from its first letter on.
    run = np.cumsum(begins((letter | has(MARK | JOIN)) & ~han))
    at = np.flatnonzero(letter)
    heads = np.zeros(len(codes), bool)
    heads[at[np.concatenate([[True], run[at][1:] != run[at][:-1]])[: len(at)]]] = True
    follows = np.concatenate([has(SPACE | HAN | QUOTE)[1:], [True]]) | last
    stops = has(STOP) | ((codes == 46) & follows)
    masks = (~has(SPACE), has(LETTER | NUMBER), han | heads | begins(number), has(SYMBOL), han, has(NUMBER), has(STRUNG), has(GARBLED), stops, has(ODD), has(BASIC))
    return np.stack([per_text(m) for m in masks], axis=1)


_RUN = re.compile("[a-z]{4,}")
_HARD = re.compile("[bcdfghjklmnpqrstvwxz]{4}")


def _measured(text: Column, lang: Column, words: dict[str, list[str]]) -> Column:
    """COUNTS; ideographs outside the basic simplified set (GB 2312), different characters, longest unbroken run of a
    script; common words of the language (of both where it is neither), words that can't be spoken."""
    names = [*COUNTS, "rare", "distinct", "longest", "common", "hard"]
    body = {k: "|".join(map(re.escape, sorted(v, key=lambda w: (-len(w), w)))) for k, v in words.items() if v}
    common = {k: re.compile(rf"(?<![a-z])(?:{b})(?![a-z])" if k == "en" else b) for k, b in body.items() if k in ("zh", "en")}

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows, parts, held, n = [], [], [], 0
        for t, lang in zip(texts, langs, strict=True):
            han, lower = "".join(_HAN_RUN.findall(t)), t.lower()
            known = sum(len(p.findall(lower)) for k, p in common.items() if lang == k or lang not in ("zh", "en"))
            hard = sum(_HARD.search(w) is not None for w in _RUN.findall(lower))
            rows.append((len(han) - len(han.encode("gb2312", "ignore")) // 2, len(set(t)), max(map(len, _UNBROKEN.split(t))), known, hard))
            held.append(t)
            n += len(t)
            if n >= CHUNK:
                parts.append(count_classes(held))
                held, n = [], 0
        parts.append(count_classes(held))
        return pd.DataFrame(np.concatenate([np.concatenate(parts), np.array(rows, dtype=np.int64).reshape(-1, 5)], axis=1), columns=names, dtype="float64")

    return run(text, lang)


def _occurrences(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def statistics(df: DataFrame, text_col: str, lang_col: str, common_words: DataFrame) -> DataFrame:
    """Add the statistics as struct ``q``. ``common_words`` (lang, word) is a small fixed table."""
    by_lang = {r.lang: sorted(r.words) for r in common_words.groupBy("lang").agg(F.collect_set("word").alias("words")).collect()}
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, r"\r\n|[\n\r\u2028\u2029\x0b\x0c\x85]"), lambda x: F.length(F.trim(x)) > 0)
    made = df.withColumn("__lines", lines).withColumn("__python", _measured(t, F.col(lang_col), by_lang))
    own = lambda c: F.col(f"__python.{c}")
    n_lines = F.greatest(F.size("__lines"), F.lit(1)).cast("double")
    share = lambda test: F.size(F.filter("__lines", test)) / n_lines
    chars = F.greatest(own("chars"), F.lit(1.0))
    words, word_chars = own("words"), own("word_chars")
    q = {
        "chars": own("chars"),
        "lines": F.size("__lines").cast("double"),
        "words": words,
        "mean_word": word_chars / F.greatest(words, F.lit(1.0)),
        "symbols": own("symbols") / chars,
        "punct_lines": share(lambda x: x.rlike(_ENDS)),
        "stops": own("stops") / chars,
        "common": own("common") / F.greatest(words, F.lit(1.0)),
        "han": own("han") / chars,
        "mean_line": own("chars") / n_lines,
        "digits": own("digits") / chars,
        "marked_lines": share(lambda x: x.rlike(r"^\s*(?:[-*•●○■□☐☑★☆◆▪·✓√]|\[[ xX]?\]|\d{1,3}\s*[.、)）:：]|[(（]\d{1,3}[)）]|[一二三四五六七八九十]{1,3}、|[①-⑳])")),
        "link_lines": share(lambda x: x.rlike(r"https?://\S+\s*$|^https?://|www\.")),
        "row_lines": share(lambda x: (
            ((_occurrences(x, ",") >= 3) & x.rlike(r",[^,]{0,30}$")) | ((_occurrences(x, ";") >= 3) & x.rlike(r";[^;]{0,30}$")) | (_occurrences(x, "\t") >= 2)
            | ((_occurrences(x, r"\|") >= 3) & x.rlike(r"^\s*\|") & x.rlike(r"\|\s*$")) | x.rlike(r"^\"[^\"]*\"(?:[;,]\"[^\"]*\"){2}") | (_occurrences(x, r"\S {2,}") >= 3)
        )),
        "short_lines": share(lambda x: (F.length(x) <= 32) & ~x.rlike(r"[。！？!?]\s*$|\.\s*$")),
        "log_lines": share(lambda x: x.rlike(r"^\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d\S*\s+(?:ERROR|WARN|INFO|DEBUG|FATAL|TRACE)|0x[0-9a-f]{6,}|^\s+at [\w.$]+\(")),
        "strung": own("strung") / F.greatest(words, F.lit(1.0)),
        "longest": F.col("__python.longest"),
        "distinct": F.col("__python.distinct"),
        "garbled": own("garbled") / chars,
        "rare": F.col("__python.rare") / chars,
        "odd_letters": own("odd") / F.greatest(own("basic"), 0.7 * chars, F.lit(20.0)),
        "hard_words": own("hard") / F.greatest(words, F.lit(1.0)),
    }
    return made.withColumn("q", F.struct(*[c.cast("double").alias(k) for k, c in q.items()])).drop("__lines", "__python")


def _functions() -> list[tuple[str, str, Column]]:
    """(name, the type it votes for, when it fires) over struct q."""
    q = lambda k: F.col(f"q.{k}")
    return [
        ("fluent", "prose", (q("common") >= F.when(q("han") > 0.3, 0.14).otherwise(0.25)) & (q("symbols") < 0.15)),
        ("sentences", "prose", q("stops").between(0.004, 0.08) & (q("mean_line") >= 18) & (q("symbols") < 0.12)),
        ("long_lines", "prose", (q("mean_line") >= 40) & (q("short_lines") < 0.55) & (q("strung") < 0.11) & (q("common") > 0.08)),
        ("worded", "prose", (q("common") >= F.when(q("han") > 0.3, 0.07).otherwise(0.2)) & (q("row_lines") < 0.5) & (q("short_lines") < 0.6) & (q("strung") < 0.12) & (q("marked_lines") < 0.5)),
        ("ended", "prose", (q("punct_lines") >= 0.6) & (q("mean_line") >= 16) & (q("symbols") < 0.12) & (q("row_lines") < 0.5) & (q("strung") < 0.12) & (q("common") > 0.08)),
        ("rows", "table", (q("row_lines") >= 0.6) & (q("lines") >= 3) & (q("common") < 0.17)),
        ("cells", "table", q("digits").between(0.05, 0.4) & (q("lines") >= 4) & (q("mean_line") < 60) & (q("row_lines") > 0.4)),
        ("delimited", "table", ((q("strung") >= 0.2) | (q("symbols") >= 0.1)) & (q("row_lines") >= 0.5) & (q("lines") >= 3)),
        ("marked", "list", q("marked_lines") >= 0.5),
        ("links", "list", (q("link_lines") >= 0.5) & (q("lines") >= 2) & (q("common") < 0.1)),
        ("entries", "list", (q("short_lines") >= 0.6) & (q("lines") >= 4) & (q("row_lines") < 0.3)),
        ("short", "list", (q("mean_line") < 26) & (q("lines") >= 4) & (q("row_lines") < 0.3)),
        ("strung", "list", (q("strung") >= 0.12) & (q("lines") <= 4) & (q("row_lines") < 0.7) & (q("symbols") < 0.4) & (q("rare") < 0.02) & (q("odd_letters") < 0.06)),
        ("unjoined", "list", (q("common") < F.when(q("han") > 0.3, 0.12).otherwise(0.24)) & (q("stops") < 0.02) & (q("strung") >= 0.1) & (q("digits") < 0.05) & (q("words") > 8) & (q("odd_letters") < 0.06)),
        ("rare", "junk", q("rare") > 0.04),
        ("garbled", "junk", q("garbled") > 0.06),
        ("symbols", "junk", q("symbols") > 0.42),
        ("monotone", "junk", (q("distinct") <= 12) & (q("chars") >= 30)),
        ("unbroken", "junk", q("longest") >= 40),
        ("machine", "junk", q("log_lines") >= 0.5),
        ("unreadable", "junk", q("hard_words") >= 0.25),
        ("odd_letters", "junk", q("odd_letters") > 0.08),
        ("no_words", "junk", (q("words") < 2) & (q("chars") >= 12)),
    ]


def votes() -> Column:
    """The labelling functions that fire, as one number with a bit for each."""
    return sum((F.when(c, 1 << i).otherwise(0) for i, (_, _, c) in enumerate(_functions())), F.lit(0)).cast("int")


def learn(counts: dict[int, int], rounds: int = 40, smooth: float = 0.5, max_slip: float = 0.2) -> dict[int, np.ndarray]:
    """Posterior over TYPES of each vote vector, by EM on the vectors' counts, from a majority start.

    Learned are each function's rates of firing on its own type (hits) and on any other (slips), and the types'
    shares. One pooled slip rate for the other types keeps a type from claiming another's functions.
    """
    names = _functions()
    target = np.array([TYPES.index(t) for _, t, _ in names])
    masks = np.array(sorted(counts), dtype=np.int64)
    if not len(masks):
        return {}
    weight = np.array([counts[int(m)] for m in masks], dtype=float)
    fired = ((masks[:, None] >> np.arange(len(names))[None, :]) & 1).astype(float)
    posterior = np.full((len(masks), len(TYPES)), 0.05)
    for t in range(len(TYPES)):
        posterior[:, t] += fired[:, target == t].sum(axis=1)
    posterior[fired.sum(axis=1) == 0] = [0.25, 0.25, 0.25, 0.25]
    posterior /= posterior.sum(axis=1, keepdims=True)
    own = target[:, None] == np.arange(len(TYPES))[None, :]
    for _ in range(rounds):
        share = (posterior * weight[:, None]).sum(axis=0)
        mass = fired.T @ (posterior * weight[:, None])
        hits = ((mass * own).sum(axis=1) + smooth * 3) / ((share[None, :] * own).sum(axis=1) + smooth * 10)
        slips = ((mass * ~own).sum(axis=1) + smooth * 0.1) / ((share[None, :] * ~own).sum(axis=1) + smooth * 10)
        hits = np.clip(hits, 1e-4, 1 - 1e-4)
        # A function is never taken to be worse than chance: its slips stay well below its hits.
        slips = np.clip(slips, 1e-5, max_slip * hits)
        rate = np.where(own, hits[:, None], slips[:, None])
        prior = (share + smooth) / (share.sum() + smooth * len(TYPES))
        logp = np.log(prior)[None, :] + fired @ np.log(rate) + (1 - fired) @ np.log(1 - rate)
        logp -= logp.max(axis=1, keepdims=True)
        posterior = np.exp(logp)
        posterior /= posterior.sum(axis=1, keepdims=True)
    return {int(m): p for m, p in zip(masks, posterior, strict=True)}


def types(df: DataFrame, id_col: str, text_col: str, lang_col: str, common_words: DataFrame) -> DataFrame:
    """(id, kind, probability) of every text that isn't blank."""
    ensure_checkpoint_dir(df.sparkSession)
    measured = statistics(df.select(id_col, text_col, lang_col), text_col, lang_col, common_words)
    voted = measured.filter(~is_blank(F.col(text_col))).select(F.col(id_col).alias("id"), votes().alias("votes")).checkpoint()
    counts = {r.votes: r["count"] for r in voted.groupBy("votes").count().collect()}  # 2 ** 23 vectors at most
    learned = [(m, TYPES[int(p.argmax())], float(p.max())) for m, p in learn(counts).items()]
    table = df.sparkSession.createDataFrame(learned, "votes int, kind string, probability double")
    table = F.broadcast(table) if len(learned) <= MAX_BROADCAST else table
    return voted.join(table, "votes").select("id", "kind", "probability")
