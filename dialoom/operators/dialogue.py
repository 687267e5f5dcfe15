"""History blobs: to messages and back. Everything here works within one cell, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.blank import is_blank, strip
from dialoom.functions.text import LINE_END, lines

_CUT = chr(1)
HEAD = r"\[[^\n]+?\]\[[^\n]+?\][^\S\n]*:"
CUSTOMER = "[客户]"
SALES_WORDS = ("销售", "CSM", "顾问", "老师")


def parse_history(history: Column) -> Column:
    """Array of (pos, speaker, ts, text): lines without a head belong to the message before, joined by a space.

    A leading line without a head is a message without speaker and time.
    """
    clean = F.array_join(lines(history), "\n")
    marked = F.regexp_replace(clean, rf"(?m)^(?={HEAD})", _CUT)
    chunks = F.filter(F.split(marked, _CUT), lambda c: strip(c) != "")
    has_head = lambda c: c.rlike(rf"^{HEAD}")
    return F.transform(chunks, lambda c, i: F.struct(
        i.cast("int").alias("pos"),
        F.when(has_head(c), F.regexp_extract(c, r"^\[([^\n]+?)\]\[", 1)).alias("speaker"),
        F.when(has_head(c), F.regexp_extract(c, r"^\[[^\n]+?\]\[([^\n]+?)\][^\S\n]*:", 1)).alias("ts"),
        strip(F.replace(F.regexp_replace(c, rf"^{HEAD}[^\S\n]*", ""), F.lit("\n"), F.lit(" "))).alias("text"),
    ))


def messages(df: DataFrame, key: str, history_col: str) -> DataFrame:
    """One row per message: key, pos, speaker, ts, text."""
    return df.select(key, F.inline(parse_history(F.col(history_col))))


def is_sales(speaker: Column, words: tuple[str, ...] = SALES_WORDS) -> Column:
    """Whether a speaker's name holds any of the words."""
    return F.coalesce(speaker.rlike("|".join(words)), F.lit(False))


def standardise(history: Column) -> Column:
    """Lines of speakers other than the customer get the head [销售]; blank lines go."""

    def one(line: Column) -> Column:
        rest = F.substring_index(line, "]", 1)
        after = F.substr(line, F.length(rest) + 2)
        timed = after.rlike(r"^\[.*\]: ")
        stamp = F.regexp_extract(after, r"^(\[.*?\]):", 1)
        body = F.substr(after, F.length(stamp) + 2)
        sales = F.when(timed, F.concat(F.lit("[销售]"), stamp, F.lit(":"), body)).when(
            after.startswith(":"), F.concat(F.lit("[销售]: "), strip(F.substr(after, F.lit(2))))
        ).otherwise(F.concat(F.lit("[销售]: "), strip(after)))
        return F.when(line.startswith(CUSTOMER) | ~line.startswith("[") | ~line.contains("]"), line).otherwise(sales)

    kept = F.filter(F.transform(F.split(history, "\n"), strip), lambda x: x != "")
    return F.when(is_blank(history), F.lit("")).otherwise(F.array_join(F.transform(kept, one), "\n"))


def clean_sales_heads(history: Column) -> Column:
    """[销售name][time] and [CSM][time] as [销售][time], where the time has its usual form."""
    stamp = r"(\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\])"
    return F.regexp_replace(F.regexp_replace(history, r"\[销售[^\]]*\]" + stamp, "[销售]$1"), r"\[CSM\]" + stamp, "[销售]$1")


def complete(history: Column, message: Column, at: Column) -> Column:
    """The standardised history with the customer's message as its last line."""
    head = F.when(is_blank(at), F.lit("[客户]: ")).otherwise(F.concat(F.lit("[客户]["), at, F.lit("]: ")))
    line = F.concat(head, strip(message))
    past = standardise(history)
    return F.when(is_blank(message), past).when(past == "", line).otherwise(F.concat(past, F.lit("\n"), line))


def until_last_customer(history: Column) -> Column:
    """The lines up to the last one of the customer; everything where there is none."""
    split = F.split(history, "\n")
    marks = F.transform(split, lambda x: strip(x).startswith(CUSTOMER))
    last = F.size(marks) - F.array_position(F.reverse(marks), True).cast("int") + 1
    return F.when(F.coalesce(history, F.lit("")) == "", "").when(F.exists(marks, lambda m: m), F.array_join(F.slice(split, F.lit(1), last), "\n")).otherwise(history)


def last_customer_message(history: Column) -> Column:
    """The text of the last customer line that has any, up to the line's end."""
    found = F.filter(F.transform(F.split(history, "\n"), strip), lambda x: x.startswith(CUSTOMER) & x.contains("]:"))
    texts = F.filter(F.transform(found, lambda x: strip(F.regexp_replace(x, r"^.*?\]:", ""))), lambda x: x != "")
    return F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))


def last_customer_block(history: Column) -> Column:
    """The last line that names the customer with the lines after it, up to the next head; stripped lines, head kept.

    A head is a line that begins with a bracketed name. Further lines that name the customer within a block belong to it.
    """
    chunks = F.split(F.regexp_replace(F.array_join(lines(history), "\n"), r"(?m)^(?=\[[^\]\n]+\])", _CUT), _CUT)
    named = F.filter(F.transform(chunks, lambda c: F.regexp_extract(c, r"(?s)(?:^|\n)([^\n]*\[客户\].*)$", 1)), lambda c: c != "")
    return F.coalesce(strip(F.try_element_at(named, F.lit(-1))), F.lit(""))


def trailing_customer_block(parsed: Column) -> Column:
    """Texts of the unbroken run of customer messages that ends a parsed history."""
    others = F.transform(parsed, lambda m: ~F.coalesce(m["speaker"] == "客户", F.lit(False)))
    run = F.when(F.exists(others, lambda o: o), F.array_position(F.reverse(others), True).cast("int") - 1).otherwise(F.size(parsed))
    return F.when(run > 0, F.transform(F.slice(parsed, -run, run), lambda m: m["text"])).otherwise(F.array().cast("array<string>"))


def customer_turns(history: Column) -> Column:
    return F.regexp_count(F.coalesce(history, F.lit("")), F.lit(r"\[客户\]"))


_ANY_HEAD = r"(?:\[([^\]\n]++)\](?:\[([^\]\n]++)\])?|(客户|销售|CSM|系统))[^\S\n]*[:：]"


def parse_any(history: Column) -> Column:
    """(pos, speaker, ts, text) of a history in any layout: a JSON list of role, content and time, bracketed heads with
    or without time, or plain ``role:`` heads. Continuation lines are joined by a line break."""
    listed = F.from_json(history, "array<struct<role:string,content:string,time:string>>")
    from_list = F.transform(F.filter(listed, lambda m: m["content"].isNotNull()), lambda m, i: F.struct(i.cast("int").alias("pos"), m["role"].alias("speaker"), m["time"].alias("ts"), strip(m["content"]).alias("text")))
    chunks = F.filter(F.split(F.regexp_replace(F.array_join(lines(history), "\n"), rf"(?m)^(?={_ANY_HEAD})", _CUT), _CUT), lambda c: strip(c) != "")
    part = lambda c, n: F.nullif(F.regexp_extract(c, rf"^{_ANY_HEAD}", n), F.lit(""))
    from_lines = F.transform(chunks, lambda c, i: F.struct(i.cast("int").alias("pos"), F.coalesce(part(c, 1), part(c, 3)).alias("speaker"), part(c, 2).alias("ts"), strip(F.regexp_replace(c, rf"^{_ANY_HEAD}", "")).alias("text")))
    empty = F.array().cast("array<struct<pos:int,speaker:string,ts:string,text:string>>")
    return F.when(is_blank(history), empty).otherwise(F.coalesce(F.when(history.rlike(r"^\s*\[\s*\{"), from_list), from_lines))


_MESSAGE = "array<struct<pos:int,speaker:string,ts:string,text:string>>"


def _chunked(rows: Column, starts: str, read: Callable[[Column], Column]) -> Column:
    """Messages of an array of lines: a chunk begins at each line that ``starts`` matches, ``read`` gives its speaker, ts
    and text (speaker empty: no message); what stands before the first one is dropped."""
    chunks = F.split(F.regexp_replace(F.array_join(rows, "\n"), rf"(?m)^(?={starts})", _CUT), _CUT)
    kept = F.filter(F.transform(F.slice(chunks, 2, 1 << 30), read), lambda m: m["speaker"] != "")
    return F.transform(kept, lambda m, i: F.struct(i.cast("int").alias("pos"), m["speaker"].alias("speaker"), m["ts"].alias("ts"), m["text"].alias("text")))


def parse_closed(history: Column) -> Column:
    """Messages of the two sides, as the tagger reads them: a JSON list of role and content; else lines, of which every
    one with a plain colon ends the message before, ``[role][time]: text`` or ``role: text`` begins one, others go on.

    Continuation lines are joined by a line break; other speakers' messages drop out with theirs.
    """
    rows = F.filter(F.transform(F.split(strip(history), "\n"), strip), lambda x: x != "")
    side = lambda c: F.when(c.isin("客户", "销售"), c).otherwise("")
    stamped = r"(?s)^\[([^\n]+?)\]\[([^\n]+?)\]:\s*([^\n].*)$"

    def read(chunk: Column) -> Column:
        timed = chunk.rlike(r"^\[[^\n]+?\]\[[^\n]+?\]:[^\S\n]*[^\s]")
        plain = F.struct(side(strip(F.substring_index(chunk, ":", 1))).alias("speaker"), F.lit("").alias("ts"), strip(F.regexp_replace(chunk, r"^[^:]*:", "")).alias("text"))
        full = F.struct(side(strip(F.regexp_extract(chunk, stamped, 1))).alias("speaker"), strip(F.regexp_extract(chunk, stamped, 2)).alias("ts"), strip(F.regexp_extract(chunk, stamped, 3)).alias("text"))
        return F.when(timed, full).otherwise(plain)

    listed = F.from_json(F.when(history.rlike(r"^\s*\["), history), "array<struct<role:string,content:string,time:string>>")
    items = F.filter(listed, lambda m: m["role"].isNotNull() & m["content"].isNotNull() & strip(m["role"]).isin("客户", "销售"))
    from_list = F.transform(items, lambda m, i: F.struct(i.cast("int").alias("pos"), strip(m["role"]).alias("speaker"), strip(F.coalesce(m["time"], F.lit(""))).alias("ts"), strip(m["content"]).alias("text")))
    is_list = history.rlike(r"^\s*\[\s*\{") & from_list.isNotNull()
    return F.when(history.isNull(), F.array().cast(_MESSAGE)).when(is_list, from_list).otherwise(_chunked(rows, r"[^\n]*:", read))


def parse_sides(history: Column) -> Column:
    """Messages under ``[客户][time]:`` and ``[销售][time]:`` heads at the line's beginning; any other line goes on the
    message before, joined by a line break, or is dropped where there is none."""
    rows = F.filter(F.transform(F.split(F.coalesce(history, F.lit("")), LINE_END), lambda x: F.regexp_replace(x, r"(?U)(?<!\s)\s++$|^\s++$", "")), lambda x: x != "")
    head = r"\[(客户|销售)\]\[([^\n]*?)\]:"
    read = lambda c: F.struct(
        F.regexp_extract(c, f"^{head}", 1).alias("speaker"), strip(F.regexp_extract(c, f"^{head}", 2)).alias("ts"),
        strip(F.array_join(F.transform(F.split(F.regexp_replace(c, f"^{head}", ""), "\n"), strip), "\n")).alias("text"),
    )
    return _chunked(rows, head, read)


def parse_prefixed(history: Column) -> Column:
    """Messages of lines that begin with ``[客户]`` or ``[销售]``: the text after ``]: ``, else after the first bracket;
    other lines go on the message before, joined by a line break, or are dropped where there is none."""
    rows = F.filter(F.transform(F.split(F.coalesce(history, F.lit("")), "\n"), strip), lambda x: x != "")
    said = lambda c: F.when(c.rlike(r"^[^\n]*?\]: "), F.regexp_replace(c, r"^[^\n]*?\]: ", "")).otherwise(F.regexp_replace(c, r"^[^\]]*\]", ""))
    read = lambda c: F.struct(F.substring(c, 2, 2).alias("speaker"), F.lit("").alias("ts"), strip(said(c)).alias("text"))
    return _chunked(rows, r"\[(?:客户|销售)\]", read)


def two_sides(parsed: Column, words: tuple[str, ...] = SALES_WORDS) -> Column:
    """Only the messages of the customer and of sales."""
    return F.filter(parsed, lambda m: (m["speaker"] == "客户") | is_sales(m["speaker"], words))


def last_customer_texts(parsed: Column, most: int = 2) -> Column:
    """The last texts of the customer run that ends a history."""
    block = trailing_customer_block(parsed)
    return F.slice(block, F.greatest(F.size(block) - most + 1, F.lit(1)), F.lit(most))


def fill_placeholders(text: Column, values: dict[str, str]) -> Column:
    """Tokens such as ``<tel>`` replaced by given constants."""
    for token, value in values.items():
        text = F.replace(text, F.lit(token), F.lit(value))
    return text


def transcripts(rows: DataFrame, chunk: int = 1000) -> DataFrame:
    """Two transcripts of each conversation, with images as their addresses and without: (file_id, chunk, full, plain).

    ``rows``: file_id, msg_id, sender_role, processed_text, message_type, file_url. A chunk holds at most ``chunk``
    messages, so no conversation, however long, becomes one cell or one task.
    """
    image = F.coalesce(F.col("message_type") == "image", F.lit(False))
    said = F.concat(F.coalesce("sender_role", F.lit("")), F.lit(": "), F.when(image, F.coalesce("file_url", F.lit(""))).otherwise(F.coalesce("processed_text", F.lit(""))))
    keyed = rows.filter("file_id is not null and msg_id is not null").select("file_id", F.floor((F.col("msg_id") - 1) / chunk).cast("int").alias("chunk"), "msg_id", said.alias("line"), image.alias("image"))
    once = keyed.groupBy("file_id", "chunk", "msg_id").agg(F.min(F.struct("line", "image")).alias("m"))
    ordered = once.groupBy("file_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("msg_id", "m"))).alias("ms"))
    text = lambda keep: F.array_join(F.transform(F.filter("ms", keep), lambda m: m["m"]["line"]), "\n")
    return ordered.select("file_id", "chunk", text(lambda m: F.lit(True)).alias("full"), text(lambda m: ~m["m"]["image"]).alias("plain"))


def reply_blocks(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """For each anchor the customer messages that answer it: (conv_id, pos, script, block, last_pos, closed).

    ``rows``: conv_id, pos, speaker, ts, text. The block is the first run of customer messages after the anchor, behind
    further sales messages at most; each line keeps its own time. ``closed`` tells whether a sales message follows it.
    An anchor that another speaker, or nothing, comes after has none.
    """
    conv = Window.partitionBy("conv_id").orderBy("pos")
    side = F.when(is_sales(F.col("speaker")), "s").when(F.col("speaker") == "客户", "c").otherwise("o")
    sided = rows.withColumns({"__side": side, "__anchor": F.coalesce(is_anchor, F.lit(False))})
    runs = sided.withColumn("__new", (F.col("__side") != F.coalesce(F.lag("__side").over(conv), F.lit(""))).cast("int")).withColumn("__run", F.sum("__new").over(conv))
    after = Window.partitionBy("conv_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = runs.withColumn("__next", F.last(F.when(F.col("__side") != "s", F.struct("__side", "__run")), ignorenulls=True).over(after)).withColumn("__follow", F.lead("__side").over(conv))
    line = F.concat(F.lit("[客户]["), F.coalesce("ts", F.lit("")), F.lit("]："), "text")
    told = ahead.filter("__side = 'c'").groupBy("conv_id", "__run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"), F.max("pos").alias("last_pos"),
        F.coalesce(F.max_by("__follow", "pos") == "s", F.lit(False)).alias("closed"),
    )
    anchors = ahead.filter("__anchor and __side = 's' and __next.__side = 'c'").select("conv_id", "pos", F.col("text").alias("script"), F.col("__next.__run").alias("__run"))
    return anchors.join(told, ["conv_id", "__run"]).select("conv_id", "pos", "script", "block", "last_pos", "closed")
