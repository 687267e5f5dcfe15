"""Template residue and error-page text (problem 6).

Method: a regularised linear classifier over hashed character n-grams, length and title features (the n-grams of
a segment's opening) scores every segment of every message, and its score alone decides. Its weak labels come from
response statuses and phrases; segments whose only mark could also be a person's own word (``undefined``, ``XX``) stay
unlabelled, so what surrounds such a mark decides. It is fitted on a bounded sample (``max_positive`` and
``max_negative`` distinct segments in hash order, and the ``max_common`` negatives said most often, whatever the size
of the corpus; all three are documented parameters); its threshold is the one with the best
F1 on hosts that the fit has not seen (``host`` is the sales desk), in the middle of the gap there.

No phrase list is complete, so a segment of residue without a listed phrase is among the weak negatives. A cross-fit
over folds of equal openings takes out the negatives that a fit without their fold clearly scores as residue (above half
the median of the positives there), if nothing in them shows a person speaking (``PERSON``) and they are not too short to tell.

Behaviour at the edges
----------------------
* null, empty and blank texts hold no residue; an empty table gives an empty result, and so does a table
  without a single weak positive, as nothing can be learned from it;
* every segment of a text of any length is scored; a history is read message by message;
* repeated rows and ties get equal answers; a null host counts as one host; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.blank import is_blank

BITS = 18
OPENING = 10
LENGTH_STEPS = 12

#: Marks of an unfilled slot that people don't type.
SLOT = (
    r"\{\{[^{}]*+\}\}|[$#]\{[^{}]*+\}|<<[^<>]++>>|@@[^@]++@@|\{%[^{}]*%\}|<%[^<>]*%>"
    r"|\[\[[^\[\]]++\]\]|\{[\w. ]++\}|%\([^()]++\)s|%\d+\$s|N/A_NAME|__\w+?__"
    r"|[（(【\[「][^（(【\[「）)】\]」]*(?:此处填|待填|请填写|插入|待补)[^）)】\]」]*+[）)】\]」]|\*{2,}待定\*{2,}|\[object object\]"
)
#: Marks that a person may also mention.
DOUBTFUL = r"XX+|某某某?|_{3,}|undefined|null|(?<![A-Za-z])nan(?![A-Za-z])|%[ds]|待定"
#: Phrases of filler texts, of error pages with their response statuses, and of notices that demand scripts.
FILLER = (
    r"lorem\s+ipsum", r"ipsum\s+dolor", r"dolor\s+sit\s+amet", r"sit\s+amet", r"amet\s+consectetur", r"consectetur\s+adipiscing", r"sed\s+do\s+eiusmod", "此处填写", r"\bTODO\b", r"\bTBD\b",
    "占位文字", "示例文[字本]", "测试文本", "测试内容", "此处为文案", "内容待定", "文案整理中", "(?:话术|文案|内容)待补充?", "替换为实际内容", "text goes here", "replace before publishing",
)
STATUS = (
    r"\b[45]\d\d\s+(?:bad request|unauthorized|forbidden|not found|method not allowed|request time-?out|too many requests|internal server error|bad gateway|service unavailable|gateway time-?out)",
    "<html|</?h1>|<title>", r"traceback\b|(?:error|exception)\s+at\s+handler", r"[{,]\s*\"(?:code|msg|trace)\"\s*:",
    "错误代码", "服务器?(?:开小差|异常|繁忙|错误)", "加载失败.{0,3}点击重试", "页面走丢", "页面不存在", "链接已失效", "an unexpected error has occurred", "err_code_", "server cannot process", "site can.?t be reached",
    "access denied", "do(?:es)? not have permission", "something went wrong", "try again later", "timed out while", "page you requested", "could not be found", "会话已过期", "重新登录后再访问",
    "访问人数过多", "系统繁忙", "请稍后(?:再试|重试)", "没有权限访问", "无法打开此内容", "访问的页面", "即将返回首页",
)
NOTICE = (
    "<noscript", r"启用\s*javascript", r"(?:enable|turn on)\s+(?:javascript|scripts?|scripting)", "need to enable", r"requires? (?:scripting|javascript)", "为了正常浏览", r"请打开\s*js", "需要运行脚本", "不支持脚本",
    "脚本被禁用", "请.{0,8}开启脚本",
)
PHRASES = FILLER + STATUS + NOTICE
#: All slots and doubtful marks count as one sign for the n-grams, so the sentence around a mark decides.
SIGN = re.compile(rf"(?i){SLOT}|{DOUBTFUL}")
SIGN_FORM = "¤¤¤"
#: Turns of phrase of somebody who talks about such things.
OWN_WORDS = r"是什么意思|什么原因|我不会|怎么弄|怎么办|看不懂|我自己|吗\W*$|吧\W*$|是不是|对吗|打不开"

#: Somebody who speaks, and the fewest characters that can tell: such segments stay weak negatives.
PERSON = rf"(?i)我|咱|俺|\bI\b|\bmy\b|{OWN_WORDS}"
LEAST_UNLISTED = 8
FOLDS, FOLD_OPENING = 3, 3


#: Line and sentence ends, media and line-break tokens, and a gap between two runs of Chinese.
CUT = r"[\n\r。！？；]+|<(?:newline|image_\d+|voice_\d+)>|\[image:[^\]\n]*+\]|(?<=[一-鿿\])0-9])\s+(?=[一-鿿【{$#<\[])"


def segments(text: Column) -> Column:
    """The sentences and lines of a message, trimmed, without empty ones."""
    parts = F.transform(F.split(text, CUT), lambda s: F.trim(s))
    return F.filter(parts, lambda s: ~is_blank(s))


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) triples of a batch of texts, all vectorised."""
    written = np.array([len(t) for t in texts], dtype=np.int64)
    texts = [SIGN.sub(SIGN_FORM, t).lower() for t in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where((codes >= 48) & (codes <= 57), np.uint64(48), codes)
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    shift = np.uint64(64 - BITS)
    docs, feats = [], []
    with np.errstate(over="ignore"):
        for n, seed in ((2, 0x9E3779B97F4A7C15), (3, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
            if len(codes) < n:
                continue
            h = np.zeros(len(codes) - n + 1, np.uint64)
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(seed)
                h ^= h >> np.uint64(29)
            whole = doc[: len(h)] == doc[n - 1 :]
            at, h = doc[: len(h)][whole], h[whole]
            docs.append(at)
            feats.append((h * np.uint64(seed)) >> shift)
            opening = place[: len(whole)][whole] < OPENING
            docs.append(at[opening])
            feats.append(((h[opening] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) >> shift)
    d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    f = np.concatenate(feats).astype(np.int64) if feats else np.zeros(0, np.int64)
    value = 1.0 / np.sqrt(np.maximum(1, np.bincount(d, minlength=len(texts))))
    size = np.minimum(LENGTH_STEPS - 1, np.log2(np.maximum(1, written)).astype(np.int64))
    every = np.arange(len(texts))
    return np.concatenate([d, every]), np.concatenate([f, (1 << BITS) + size]), np.concatenate([value[d], np.ones(len(texts))])


@dataclass
class Residue:
    """A fitted classifier: one weight per hashed feature and length step, the threshold, and how unseen hosts were judged."""

    weights: np.ndarray
    threshold: float
    unseen: dict[str, float]

    def score(self, texts: list[str]) -> np.ndarray:
        d, f, v = _features(texts)
        return np.bincount(d, weights=self.weights[f] * v, minlength=len(texts)) if len(texts) else np.zeros(0)


def fit_linear(texts: list[str], labels: np.ndarray, l2: float = 1e-3, rounds: int = 150, rate: float = 0.5) -> np.ndarray:
    """Logistic regression with an L2 penalty and balanced classes, by full-batch adaptive gradient steps."""
    d, f, v = _features(texts)
    w, seen = np.zeros((1 << BITS) + LENGTH_STEPS), np.full((1 << BITS) + LENGTH_STEPS, 1e-8)
    positive = max(1, labels.sum())
    weight = np.where(labels > 0, 0.5 / positive, 0.5 / max(1, len(labels) - positive))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(d, weights=w[f] * v, minlength=len(texts)), -30, 30)))
        g = np.bincount(f, weights=(weight * (p - labels))[d] * v, minlength=len(w)) + l2 * w / len(w)
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _unlisted_text(text: str) -> bool:
    return len(text) >= LEAST_UNLISTED and not re.search(PERSON, text)


def _without_suspects(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Places of the rows to fit on: all but the negatives that a fit on the other folds takes for residue.

    Texts that open alike are in one fold, so copies of an unlisted template don't vouch for each other.
    """
    fold, suspect = np.array([zlib.crc32(t[:FOLD_OPENING].encode("utf-8", "replace")) % FOLDS for t in texts]), np.zeros(len(texts), bool)
    for k in range(FOLDS):
        fit, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not labels[fit].any() or labels[fit].all() or not len(rest):
            continue
        scores = Residue(fit_linear([texts[i] for i in fit], labels[fit], rounds=60), 0.0, {}).score([texts[i] for i in rest])
        own = scores[labels[rest] == 1]
        clear = max(0.0, float(np.median(own)) / 2) if len(own) else 0.0
        suspect[[i for i in rest[(labels[rest] == 0) & (scores > clear)] if _unlisted_text(texts[i])]] = True
    return np.flatnonzero(~suspect)


def best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The cut with the best F1, in the middle between the two scores that it parts."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + max(1, truth.sum()))
    f1[:-1][s[:-1] == s[1:]] = -1.0  # equal scores can't be parted
    at = int(np.argmax(f1))
    return float((s[at] + s[at + 1]) / 2 if at + 1 < len(s) else s[at])


def train(
    pieces: DataFrame, host_col: str, max_positive: int = 4000, max_negative: int = 8000, max_common: int = 4000, held_out: int = 5, withheld: frozenset[str] = frozenset()
) -> Residue | None:
    """Fit on a bounded sample of weakly labelled segments (column ``segment``); None without a weak positive.

    One host in ``held_out``, by hash, is kept from the fit: what only such hosts say sets the threshold.
    ``withheld``: phrases that the labels don't know, to measure how far the classifier reaches beyond its lists.
    """
    listed = "|".join([SLOT, *(x for x in PHRASES if x not in withheld)])
    certain, evidence = rf"(?iU)(?:{listed})", rf"(?iU)(?:{listed}|{DOUBTFUL})"
    label = F.when(F.col("segment").rlike(certain), 1).when(~F.col("segment").rlike(evidence) | F.col("segment").rlike(OWN_WORDS), 0)
    kept_out = F.pmod(F.xxhash64(F.coalesce(F.col(host_col), F.lit(""))), F.lit(held_out)) == 0
    distinct = pieces.select("segment", kept_out.alias("out")).groupBy("segment").agg(F.bool_and("out").alias("unseen"), F.count(F.lit(1)).alias("said"))
    once = distinct.select("segment", "unseen", "said", label.alias("label")).filter(F.col("label").isNotNull()).persist()
    by_hash = [F.xxhash64("segment"), F.col("segment")]
    ranked = [
        once.filter(F.col("label") == want).orderBy(*order).limit(most)
        for want, most, order in ((1, max_positive, by_hash), (0, max_negative, by_hash), (0, max_common, [F.desc("said"), *by_hash]))
    ]
    rows = reduce(DataFrame.unionByName, ranked).distinct().orderBy(*by_hash).collect()
    once.unpersist()
    if not any(r.label for r in rows):
        return None
    fitted = [r for r in rows if not r.unseen] or rows
    texts, labels = [r.segment for r in fitted], np.array([float(r.label) for r in fitted])
    kept = _without_suspects(texts, labels)
    model = Residue(fit_linear([texts[i] for i in kept], labels[kept]), 0.0, {})
    unseen = [r for r in rows if r.unseen]
    judge = unseen if len({r.label for r in unseen}) == 2 else rows
    scores, truth = model.score([r.segment for r in judge]), np.array([r.label for r in judge])
    model.threshold = best_threshold(scores, truth)
    hit = scores >= model.threshold
    model.unseen = {"segments": len(judge), "precision": float(truth[hit].mean()) if hit.any() else 1.0, "recall": float(hit[truth == 1].mean())}
    return model


def found(fields: DataFrame, id_cols: list[str], messages_col: str, host_col: str, model: Residue | None = None) -> DataFrame:
    """The ids of the rows that hold a segment of residue. ``messages_col`` is an array of message texts."""
    pieces = fields.select(*id_cols, host_col, F.explode(F.flatten(F.transform(F.col(messages_col), segments))).alias("segment"))
    model = model or train(pieces, host_col)
    if model is None:
        return fields.select(*id_cols).limit(0)
    shared = fields.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.threshold))

    @F.pandas_udf("boolean")
    def is_residue(texts: pd.Series) -> pd.Series:
        weights, threshold = shared.value
        place, once = pd.factorize(texts)  # talk repeats itself: each text of a batch is scored once
        return pd.Series((Residue(weights, threshold, {}).score(once.tolist()) >= threshold)[place])

    return pieces.filter(is_residue("segment")).select(*id_cols).distinct()
