"""Queries on history blobs and single messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions import blank, questions, text
from dialoom.operators import dialogue as D
from dialoom.operators import scripts as S
from dialoom.plans.propagation_queries import blank as sql_blank
from dialoom.session import table


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tagging_corpus").select("conv_id", "final_context")


def scan_project_blank(spark, sf_dir):
    c = F.col("message")
    rows = table(spark, sf_dir, "reflow_rows")
    return rows.select("row_order", blank.is_blank(c).alias("blank"), blank.normalise_value(c).alias("value"), blank.is_valid_payload(F.col("rag")).alias("valid_rag"))


def parse_history(spark, sf_dir):
    return D.messages(_corpus(spark, sf_dir), "conv_id", "final_context")


def standardize_speakers(spark, sf_dir):
    return _corpus(spark, sf_dir).select("conv_id", D.standardise(F.col("final_context")).alias("history"), D.clean_sales_heads(F.col("final_context")).alias("cleaned"))


def complete_conversation(spark, sf_dir):
    rows = table(spark, sf_dir, "reflow_rows").filter(F.col("sender") == "客户")
    return rows.select("row_order", D.complete(F.col("history"), F.col("message"), F.col("message_time")).alias("conversation"))


def truncate_to_last_customer(spark, sf_dir):
    return _corpus(spark, sf_dir).select("conv_id", D.until_last_customer(F.col("final_context")).alias("history"))


def last_customer_message(spark, sf_dir):
    h = F.col("final_context")
    return _corpus(spark, sf_dir).select("conv_id", D.last_customer_message(h).alias("message"), D.customer_turns(h).cast("int").alias("turns"))


def sync_latest_message(spark, sf_dir):
    """The last customer block of each context beside the stored message, and whether it differs."""
    rows = table(spark, sf_dir, "tagging_corpus").withColumn("block", D.last_customer_block(F.col("final_context")))
    return rows.select("conv_id", "block", ((F.col("block") != "") & ~F.col("block").eqNullSafe(F.col("latest_message"))).alias("changed"))


def merge_trailing_block(spark, sf_dir):
    parsed = _corpus(spark, sf_dir).select("conv_id", D.parse_history(F.col("final_context")).alias("m"))
    block = D.trailing_customer_block(F.col("m"))
    return parsed.select("conv_id", F.size(block).alias("messages"), F.array_join(block, " ").alias("merged"))


def sales_rounds(spark, sf_dir):
    """Rounds of consecutive sales messages, counted from the start and from the end."""
    rows = D.messages(_corpus(spark, sf_dir), "conv_id", "final_context").withColumn("sales", D.is_sales(F.col("speaker")))
    conv = Window.partitionBy("conv_id").orderBy("pos")
    begins = F.col("sales") & ~F.coalesce(F.lag("sales").over(conv), F.lit(False))
    rounds = rows.withColumn("round", F.sum(begins.cast("int")).over(conv)).filter("sales")
    whole = Window.partitionBy("conv_id")
    return rounds.select("conv_id", "pos", F.col("round").cast("int").alias("round"), (F.max("round").over(whole) - F.col("round") + 1).cast("int").alias("round_from_last"), F.row_number().over(whole.orderBy(F.desc("pos"))).alias("turn_from_last"))


def sales_blocks_around_last(spark, sf_dir):
    """The unbroken runs of sales messages before and after the last customer run."""
    rows = D.messages(_corpus(spark, sf_dir), "conv_id", "final_context").withColumn("side", F.when(D.is_sales(F.col("speaker")), "s").when(F.col("speaker") == "客户", "c").otherwise("o"))
    conv = Window.partitionBy("conv_id").orderBy("pos")
    runs = rows.withColumn("run", F.sum((F.coalesce(F.lag("side").over(conv), F.lit("")) != F.col("side")).cast("int")).over(conv))
    last = runs.withColumn("last", F.max(F.when(F.col("side") == "c", F.col("run"))).over(Window.partitionBy("conv_id")))
    join = lambda d: F.coalesce(F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("side") == "s") & (F.col("run") == F.col("last") + d), F.struct("pos", "text")))), lambda x: x["text"]), " "), F.lit(""))
    return last.groupBy("conv_id").agg(join(-1).alias("before"), join(1).alias("after"))


def sentence_split(spark, sf_dir):
    rows = table(spark, sf_dir, "reflow_rows").select("row_order", F.posexplode(text.sentences(F.col("sent_text"))).alias("place", "sentence"))
    return rows.select("row_order", F.col("place").cast("int").alias("place"), "sentence")


def question_flags(spark, sf_dir):
    c = F.col("latest_message")
    return table(spark, sf_dir, "testset").select("case_id", questions.is_question_quoted(c).alias("quoted"), questions.is_question_loose(c).alias("loose"), questions.is_question_anchored(c).alias("anchored"))


def classify_message(spark, sf_dir):
    return table(spark, sf_dir, "testset").select("case_id", questions.message_class(F.col("latest_message"), F.col("is_question")).alias("message_class"))


def media_only_filter(spark, sf_dir):
    return table(spark, sf_dir, "testset").filter(questions.only_media(F.col("last_sales_messages"))).select("case_id")


def text_forms(spark, sf_dir):
    """Each normaliser on the sent texts."""
    c = F.col("sent_text")
    return table(spark, sf_dir, "reflow_rows").select(
        "row_order", text.match_key(c).alias("match_key"), text.letters_only(c).alias("letters"), text.template_form(c).alias("template"), text.without_space(c).alias("dense")
    )


def char_set_ops(spark, sf_dir):
    """Characters that a message shares with its node's label, and those only it has."""
    chars = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""))
    a, b = chars(F.col("latest_message")), chars(F.col("sop_l2"))
    return table(spark, sf_dir, "tagging_corpus").select("conv_id", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_except(a, b)).alias("own"), F.size(F.array_union(a, b)).alias("either"))


def script_variants(spark, sf_dir):
    return table(spark, sf_dir, "sop_scripts").select("script_id", F.posexplode(text.script_variants(F.col("script_text"))).alias("place", "variant")).withColumn("place", F.col("place").cast("int"))


def split_transmit_action(spark, sf_dir):
    """Statement and closing question of each sent text."""
    rows = table(spark, sf_dir, "reflow_rows").filter("sent_text is not null")
    return rows.select("row_order", text.split_utterance(F.col("sent_text")).alias("s")).select("row_order", "s.statement", "s.question")


def expected_parts(spark, sf_dir):
    """Parts of the utterances in cells of several kinds: plain, under one label, under several, the scripts' own ones settled."""
    rows = table(spark, sf_dir, "reflow_rows").filter("sent_text is not null").select("row_order", "sop_l2", "sent_text")
    under = lambda *labels: F.to_json(F.create_map(*[x for label in labels for x in (label, F.col("sent_text"))]))
    kind = F.col("row_order") % 5
    cell = F.when(kind == 0, F.col("sent_text")).when(kind == 1, under(F.lit("提醒上课"))).when(kind == 2, under(F.lit("甲"), F.lit("乙"))).when(kind == 3, under(F.lit("甲"))).otherwise("[1]")
    scripts = table(spark, sf_dir, "sop_scripts").select(blank.strip(F.col("script_text")).alias("utterance"))
    lookup = scripts.select("utterance", F.lit("已定").alias("statement"), F.col("utterance").alias("question"))
    return S.expected_parts(rows.select("row_order", cell.alias("cell")), "cell", lookup).select("row_order", "statement", "question")


def duplicate_judge(spark, sf_dir):
    """Whether an assistant's text and what was sent are the same but for white space."""
    a, b = F.col("ai_text"), F.col("sent_text")
    none = lambda c: blank.is_blank(c)
    same = text.without_space(a) == text.without_space(b)
    verdict = F.when(none(a) & none(b), "无AI消息").when(none(a) | none(b), "缺少一条AI消息").when(same, "是").otherwise("否")
    return table(spark, sf_dir, "reflow_rows").select("row_order", verdict.alias("verdict"))


def case_contexts(spark, sf_dir):
    """A case for each customer message that follows a scripted reply: the dialogue up to it and the one after."""
    scripts = F.broadcast(table(spark, sf_dir, "sop_scripts").select(F.trim("script_text").alias("text")).distinct().withColumn("scripted", F.lit(True)))
    rows = D.messages(_corpus(spark, sf_dir), "conv_id", "final_context").join(scripts, "text", "left")
    conv = Window.partitionBy("conv_id").orderBy("pos")
    line = F.concat_ws(": ", F.coalesce("speaker", F.lit("")), "text")
    told = rows.withColumns({"line": line, "anchor": F.col("scripted").isNotNull() & D.is_sales(F.col("speaker"))})
    asked = told.withColumn("cut", (F.col("speaker") == "客户") & F.lag("anchor", 1, False).over(conv)).filter("cut").select("conv_id", "pos")
    # One array for each conversation that has a cut; each case is a slice of it, and only cases carry text.
    whole = told.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("all"))
    text_of = lambda part: F.array_join(F.transform(part, lambda x: x["line"]), "\n")
    return asked.join(whole, "conv_id").select(
        "conv_id", "pos", text_of(F.filter("all", lambda x: x["pos"] <= F.col("pos"))).alias("context"), text_of(F.filter("all", lambda x: x["pos"] > F.col("pos"))).alias("rest")
    )


def _dialect(spark, sf_dir, parse):
    return table(spark, sf_dir, "testset").select("case_id", F.inline(parse(F.col("history")))).select("case_id", "pos", "speaker", "ts", "text")


def parse_closed(spark, sf_dir):
    """Messages of the test set's histories as the tagger reads them."""
    return _dialect(spark, sf_dir, D.parse_closed)


def parse_sides(spark, sf_dir):
    return _dialect(spark, sf_dir, D.parse_sides)


def parse_prefixed(spark, sf_dir):
    return _dialect(spark, sf_dir, D.parse_prefixed)


def mapped_pairs(spark, sf_dir):
    """The first two values of each context as a mapping of turns, joined."""
    rows = table(spark, sf_dir, "testset").select("case_id", F.to_json(F.struct("latest_message", "nickname", "tags")).alias("mapping"))
    return rows.select("case_id", F.array_join(text.first_values(F.col("mapping")), "|").alias("pair"))


def reply_blocks(spark, sf_dir):
    """The customer's messages that answer a scripted reply."""
    scripts = F.broadcast(table(spark, sf_dir, "sop_scripts").select(F.trim("script_text").alias("text")).distinct().withColumn("scripted", F.lit(True)))
    return D.reply_blocks(D.messages(_corpus(spark, sf_dir), "conv_id", "final_context").join(scripts, "text", "left"), F.col("scripted"))


def parse_history_any(spark, sf_dir):
    """Messages of the test set's histories, whatever their layout."""
    return table(spark, sf_dir, "testset").select("case_id", F.inline(D.two_sides(D.parse_any(F.col("history")))))


def last_two_customer(spark, sf_dir):
    parsed = _corpus(spark, sf_dir).select("conv_id", D.parse_history(F.col("final_context")).alias("m"))
    return parsed.select("conv_id", F.array_join(D.last_customer_texts(F.col("m")), "|").alias("texts"))


def transcript_chunks(spark, sf_dir):
    return D.transcripts(table(spark, sf_dir, "chat_messages"))


QUERIES = {
    f.__name__: f
    for f in (scan_project_blank, parse_history, standardize_speakers, complete_conversation, truncate_to_last_customer, last_customer_message, sync_latest_message, merge_trailing_block, sales_rounds, sales_blocks_around_last, sentence_split, question_flags, classify_message, media_only_filter, text_forms, char_set_ops, script_variants, split_transmit_action, expected_parts, duplicate_judge, case_contexts, parse_closed, parse_sides, parse_prefixed, mapped_pairs, reply_blocks, parse_history_any, last_two_customer, transcript_chunks)
}

_W = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


#: What Java's Unicode word characters are, for RE2.
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"


def half_sql(c: str) -> str:
    narrow = text._NARROW.replace("'", "''")
    return f"translate({c}, '{text._WIDE}', '{narrow}')"


def match_key_sql(c: str) -> str:
    return f"regexp_replace(lower({half_sql(c)}), '[^{WORD}]+', '', 'g')"


_HEAD = r"^\[(.+?)\]\[(.+?)\]\s*:\s*(.*)$"
MESSAGES = f"""
l AS (SELECT conv_id, i, {_strip('line')} AS line FROM (SELECT conv_id, unnest(string_split_regex(final_context, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line, generate_subscripts(string_split_regex(final_context, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) AS i FROM tagging_corpus)),
h AS (SELECT *, regexp_matches(line, '{_HEAD}') AS head FROM l WHERE line <> ''),
g AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY conv_id ORDER BY i) AS grp FROM h),
m AS (SELECT conv_id, grp, max(CASE WHEN head THEN regexp_extract(line, '{_HEAD}', 1) END) AS speaker, max(CASE WHEN head THEN regexp_extract(line, '{_HEAD}', 2) END) AS ts,
  {_strip("string_agg(CASE WHEN head THEN regexp_extract(line, '" + _HEAD + "', 3) ELSE line END, ' ' ORDER BY i)")} AS text FROM g GROUP BY conv_id, grp),
msgs AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY grp) - 1 AS INT) AS pos, speaker, ts, text FROM m)"""
SALES = "coalesce(regexp_matches(speaker, '销售|CSM|顾问|老师'), FALSE)"
_LINE5 = f"""CASE WHEN starts_with(x, '[客户]') OR NOT starts_with(x, '[') OR NOT contains(x, ']') THEN x
  WHEN regexp_matches(substring(x, strpos(x, ']') + 1), '^\\[.*\\]: ') THEN '[销售]' || regexp_extract(substring(x, strpos(x, ']') + 1), '^(\\[.*?\\]):', 1) || ':' || regexp_replace(substring(x, strpos(x, ']') + 1), '^\\[.*?\\]:', '')
  WHEN starts_with(substring(x, strpos(x, ']') + 1), ':') THEN '[销售]: ' || {_strip("substring(x, strpos(x, ']') + 2)")}
  ELSE '[销售]: ' || {_strip("substring(x, strpos(x, ']') + 1)")} END"""


def _standard(c: str) -> str:
    return f"CASE WHEN {sql_blank(c)} THEN '' ELSE array_to_string(list_transform(list_filter(list_transform(string_split({c}, chr(10)), lambda y: {_strip('y')}), lambda y: y <> ''), lambda x: {_LINE5}), chr(10)) END"


_ANY = "？|\\?|什么|怎么|如何|哪个|哪里|哪些|谁|何时|多少|啥|咋|怎样|几|多久|多长|是哪|吗|呢"  # the signs that no other sign is part of


def _split_sql(source: str) -> str:
    """CTEs that end in ``parts`` (id, statement, question) of a CTE body selecting (id, u)."""
    q = lambda c, p, g: f"regexp_extract({c}, '{p}', {g}, 's')"
    filler = f"^((?:{'|'.join(sorted(text.FILLERS, key=len, reverse=True))})[，,。！!；;、]*)\\s*(.+)$"
    stop, comma, before = (f"^(.*[{c}])({d})$" for c, d in (("。！!；;\\n", "[^。！!；;\\n]*"), ("，,", "[^，,]*"), ("，,", "[^，,]*[，,][^，,]*")))
    stored = lambda c: _strip(f"replace({c}, chr(10), '<newline>')")
    return f"""u1 AS ({source}),
u2 AS (SELECT id, replace({_strip("replace(u, chr(13) || chr(10), chr(10))")}, '<newline>', chr(10)) AS v FROM u1),
u3 AS (SELECT *, {q('v', '^(.*[?？])', 1)} AS h FROM u2),
u4 AS (SELECT *, CASE WHEN {q('h', stop, 1)} <> '' THEN {q('h', stop, 1)}
  WHEN {q('h', before, 1)} <> '' AND length({_strip(q('h', comma, 2))}) <= 12 THEN {q('h', before, 1)} ELSE {q('h', comma, 1)} END AS d FROM u3),
u5 AS (SELECT *, regexp_replace(d, '{_W}+$', '') AS lead, {_strip('substring(h, length(d) + 1)')} AS clause FROM u4),
parts AS (SELECT id, {stored(f"CASE WHEN h = '' THEN v WHEN lead = '' THEN {q('clause', filler, 1)} ELSE lead END")} AS statement,
  {stored(f"CASE WHEN h = '' THEN '' WHEN lead = '' AND {q('clause', filler, 1)} <> '' THEN {q('clause', filler, 2)} ELSE clause END")} AS question FROM u5)"""


def _lines_sql(split: str, clean: str, keep: str, start: str) -> str:
    """CTE ``k`` (case_id, i, n, line): lines of the histories with the number of their chunk, 0 before the first one."""
    return f"""l AS (SELECT case_id, unnest(a) AS raw, generate_subscripts(a, 1) AS i FROM (SELECT case_id, {split} AS a FROM testset WHERE history IS NOT NULL AND {keep})),
c AS (SELECT case_id, i, {clean} AS line FROM l), k AS (SELECT *, sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY i) AS n FROM c WHERE line <> '')"""


def _chunks_sql(speaker: str, ts: str, first: str, more: str) -> str:
    return f"""h AS (SELECT case_id, n, {_strip("string_agg(CASE WHEN f THEN " + first + " ELSE " + more + " END, chr(10) ORDER BY i)")} AS text, max(CASE WHEN f THEN {speaker} END) AS speaker, max(CASE WHEN f THEN {ts} END) AS ts
  FROM (SELECT *, i = min(i) OVER (PARTITION BY case_id, n) AS f FROM k WHERE n > 0) GROUP BY 1, 2)
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY n) - 1 AS INT) AS pos, speaker, ts, text FROM h WHERE speaker IN ('客户', '销售')"""


_TIMED = "regexp_matches(line, '^\\[.+?\\]\\[.+?\\]:\\s*\\S')"
_SIDE = "^\\[(客户|销售)\\]\\[(.*?)\\]:"
_LISTED = "regexp_matches(history, '^\\s*\\[\\s*\\{') AND json_valid(history)"
_EVERY_END = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"
ORACLES = {
    "parse_closed": f"""WITH {_lines_sql(f"string_split({_strip('history')}, chr(10))", _strip('raw'), f"NOT ({_LISTED})", "contains(line, ':')")},
{_chunks_sql(f"CASE WHEN {_TIMED} THEN {_strip("regexp_extract(line, '^\\[(.+?)\\]\\[', 1)")} ELSE {_strip("split_part(line, ':', 1)")} END", f"CASE WHEN {_TIMED} THEN {_strip("regexp_extract(line, '^\\[.+?\\]\\[(.+?)\\]:', 1)")} ELSE '' END", f"CASE WHEN {_TIMED} THEN regexp_replace(line, '^\\[.+?\\]\\[.+?\\]:\\s*', '') ELSE regexp_replace(line, '^[^:]*:', '') END", "line")}
UNION ALL SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY i) - 1 AS INT), {_strip('m.role')}, {_strip("coalesce(m.time, '')")}, {_strip('m.content')}
FROM (SELECT case_id, unnest(a) AS m, generate_subscripts(a, 1) AS i FROM (SELECT case_id, from_json(CASE WHEN {_LISTED} THEN history END, '[{{"role":"VARCHAR","content":"VARCHAR","time":"VARCHAR"}}]') AS a FROM testset))
WHERE {_strip('m.role')} IN ('客户', '销售') AND m.content IS NOT NULL""",
    "parse_sides": f"""WITH {_lines_sql(f"string_split_regex(history, {_EVERY_END})", f"regexp_replace(raw, '{_W}+$', '')", "TRUE", f"regexp_matches(line, '{_SIDE}')")},
{_chunks_sql(f"regexp_extract(line, '{_SIDE}', 1)", _strip(f"regexp_extract(line, '{_SIDE}', 2)"), f"regexp_replace(line, '{_SIDE}', '')", _strip("line"))}""",
    "parse_prefixed": f"""WITH {_lines_sql("string_split(history, chr(10))", _strip('raw'), "TRUE", "(starts_with(line, '[客户]') OR starts_with(line, '[销售]'))")},
{_chunks_sql("substring(line, 2, 2)", "''", "CASE WHEN contains(line, ']: ') THEN substring(line, strpos(line, ']: ') + 3) ELSE substring(line, strpos(line, ']') + 1) END", "line")}""",
    "split_transmit_action": f"WITH {_split_sql('SELECT row_order AS id, sent_text AS u FROM reflow_rows WHERE sent_text IS NOT NULL')} SELECT id AS row_order, statement, question FROM parts",
    "expected_parts": f"""WITH {_split_sql('SELECT row_order AS id, sent_text AS u FROM reflow_rows WHERE sent_text IS NOT NULL')},
r AS (SELECT row_order, row_order % 5 AS kind, {_strip("replace(sent_text, chr(13) || chr(10), chr(10))")} AS u FROM reflow_rows WHERE sent_text IS NOT NULL),
k AS (SELECT DISTINCT {_strip('script_text')} AS u, TRUE AS known FROM sop_scripts)
SELECT row_order, CASE WHEN kind IN (1, 2, 4) OR (kind = 0 AND json_valid(u) AND lower(u) <> 'nan') THEN '' WHEN known THEN '已定' ELSE statement END AS statement,
  CASE WHEN kind IN (2, 4) OR (kind = 0 AND json_valid(u) AND lower(u) <> 'nan') THEN '' WHEN kind = 1 OR known THEN u ELSE question END AS question FROM r JOIN parts ON id = row_order LEFT JOIN k USING (u)""",
    "scan_project_blank": f"""SELECT row_order, {sql_blank('message')} AS blank,
  CASE WHEN lower({_strip("coalesce(message, '')")}) IN ('none', 'nan') THEN '' ELSE {_strip("coalesce(message, '')")} END AS value,
  lower({_strip("coalesce(rag, '')")}) NOT IN ('', 'nan', '[]') AS valid_rag FROM reflow_rows""",
    "parse_history": f"WITH {MESSAGES.strip()} SELECT * FROM msgs",
    "standardize_speakers": f"""SELECT conv_id, {_standard('final_context')} AS history,
  regexp_replace(regexp_replace(final_context, '\\[销售[^\\]]*\\](\\[\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}\\])', '[销售]\\1', 'g'), '\\[CSM\\](\\[\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}\\])', '[销售]\\1', 'g') AS cleaned FROM tagging_corpus""",
    "complete_conversation": f"""WITH s AS (SELECT row_order, {_standard('history')} AS past, CASE WHEN {sql_blank('message_time')} THEN '[客户]: ' ELSE '[客户][' || message_time || ']: ' END || {_strip('message')} AS line, {sql_blank('message')} AS b FROM reflow_rows WHERE sender = '客户')
SELECT row_order, CASE WHEN b THEN past WHEN past = '' THEN line ELSE past || chr(10) || line END AS conversation FROM s""",
    "truncate_to_last_customer": f"""WITH l AS (SELECT conv_id, final_context, string_split(final_context, chr(10)) AS a FROM tagging_corpus),
p AS (SELECT *, list_max(list_transform(a, lambda x, i: CASE WHEN starts_with({_strip('x')}, '[客户]') THEN i END)) AS last FROM l)
SELECT conv_id, CASE WHEN coalesce(final_context, '') = '' THEN '' WHEN last IS NOT NULL THEN array_to_string(a[1:last], chr(10)) ELSE final_context END AS history FROM p""",
    "last_customer_message": f"""WITH l AS (SELECT conv_id, final_context, list_filter(list_transform(list_filter(list_transform(string_split(final_context, chr(10)), lambda x: {_strip('x')}), lambda x: starts_with(x, '[客户]') AND contains(x, ']:')), lambda x: {_strip("regexp_replace(x, '^.*?\\]:', '')")}), lambda x: x <> '') AS a FROM tagging_corpus)
SELECT conv_id, coalesce(a[-1], '') AS message, CAST(len(regexp_extract_all(coalesce(final_context, ''), '\\[客户\\]')) AS INT) AS turns FROM l""",
    "merge_trailing_block": f"""WITH {MESSAGES.strip()},
e AS (SELECT *, max(CASE WHEN coalesce(speaker, '') <> '客户' THEN pos END) OVER (PARTITION BY conv_id) AS brk FROM msgs),
b AS (SELECT conv_id, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS merged FROM e WHERE brk IS NULL OR pos > brk GROUP BY conv_id)
SELECT t.conv_id, CAST(coalesce(n, 0) AS INT) AS messages, coalesce(merged, '') AS merged FROM tagging_corpus t LEFT JOIN b USING (conv_id)""",
    "sales_rounds": f"""WITH {MESSAGES.strip()},
s AS (SELECT *, {SALES} AS sales FROM msgs),
r AS (SELECT *, sum(CASE WHEN sales AND NOT coalesce(lagged, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS round FROM (SELECT *, lag(sales) OVER (PARTITION BY conv_id ORDER BY pos) AS lagged FROM s))
SELECT conv_id, pos, CAST(round AS INT) AS round, CAST(max(round) OVER (PARTITION BY conv_id) - round + 1 AS INT) AS round_from_last, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS INT) AS turn_from_last FROM r WHERE sales""",
    "sales_blocks_around_last": f"""WITH {MESSAGES.strip()},
s AS (SELECT *, CASE WHEN {SALES} THEN 's' WHEN speaker = '客户' THEN 'c' ELSE 'o' END AS side FROM msgs),
r AS (SELECT *, sum(CASE WHEN coalesce(lagged, '') <> side THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM (SELECT *, lag(side) OVER (PARTITION BY conv_id ORDER BY pos) AS lagged FROM s)),
z AS (SELECT *, max(CASE WHEN side = 'c' THEN run END) OVER (PARTITION BY conv_id) AS last FROM r)
SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE side = 's' AND run = last - 1), '') AS before, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE side = 's' AND run = last + 1), '') AS after FROM z GROUP BY conv_id""",
    "sentence_split": f"""WITH n AS (SELECT row_order, {_strip("replace(replace(replace(sent_text, '<newline>', chr(10)), '\\n', chr(10)), '：', ':')")} AS t FROM reflow_rows WHERE sent_text IS NOT NULL),
a AS (SELECT row_order, t, list_filter(list_transform(string_split_regex(t, '[\\n。！？?!]+'), lambda x: {_strip('x')}), lambda x: x <> '') AS parts FROM n),
b AS (SELECT row_order, CASE WHEN len(parts) > 0 THEN parts WHEN t <> '' THEN [t] ELSE [] END AS parts FROM a)
SELECT row_order, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS place, unnest(parts) AS sentence FROM b""",
    "question_flags": f"""WITH s AS (SELECT case_id, latest_message, {_strip("coalesce(latest_message, '')")} AS t, {_strip("string_split(coalesce(latest_message, ''), '- - - - - - - - - - - - - - -')[-1]")} AS q,
  regexp_replace({_strip("coalesce(latest_message, '')")}, '[。．.…!！；;,\\s]+$', '') AS bare FROM testset)
SELECT case_id, NOT {sql_blank('latest_message')} AND length(q) > 1 AND regexp_matches(q, '{_ANY}|不|吧') AS quoted, length(t) > 1 AND (regexp_matches(t, '{_ANY}') OR regexp_matches(t, '(吗|呢|不|吧)$')) AS loose,
  regexp_matches(t, '[?？]') OR regexp_matches(bare, '(吗|嘛|么|呢|吧|对吗|对吧|好不好|要不要|行不行|是不是|可不可以|能不能|行吗|行么|行嘛|好吗|好么|好嘛)$')
  OR regexp_matches(bare, '^(能否|是否|可否|能不能|什么|怎么|怎样|为何|为什么|哪个|哪种|哪些|哪里|哪儿|哪家|哪位|谁|何时|几时|多少|多久|多长|多远|多大|多高|多重|几岁|几天|几月|几号)')
  OR regexp_matches(t, '可不可以|能不能|要不要|好不好|行不行|(能否|是否|可否)[^。！？]*?(吗|呢|吧|\\?|？)') OR (contains(t, '请问') AND regexp_matches(t, '可以|能|可否|是否')) AS anchored FROM s""",
    "classify_message": """SELECT case_id, CASE WHEN regexp_matches(t, '好|可以|是的|ok|收到') THEN '确认回复' WHEN regexp_matches(t, '不|没') THEN '拒绝回复' WHEN is_question THEN '疑问询问' WHEN regexp_matches(t, '谢谢|感谢|辛苦') THEN '感谢表达'
  WHEN length(t) > 50 THEN '详细描述' WHEN regexp_matches(t, '了解|明白|清楚|知道') THEN '理解确认' ELSE '其他回复' END AS message_class FROM (SELECT *, lower(coalesce(latest_message, 'nan')) AS t FROM testset)""",
    "media_only_filter": f"SELECT case_id FROM testset WHERE len(last_sales_messages) > 0 AND len(list_filter(last_sales_messages, lambda m: NOT ({_strip('m')} = '' OR regexp_matches({_strip('m')}, '^<(image|voice|video|emotion)_')))) = 0",
    "text_forms": f"""SELECT row_order, {match_key_sql('sent_text')} AS match_key,
  trim(regexp_replace(lower(regexp_replace({half_sql('sent_text')}, '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9\\s\\p{{Z}}\\x{{85}}\\x0b]', '', 'g')), '[\\s\\p{{Z}}\\x{{85}}\\x0b]+', ' ', 'g')) AS letters,
  lower(regexp_replace(trim(regexp_replace(replace(sent_text, '<newline>', ' '), '[^{WORD}]+', ' ', 'g')), '\\p{{Nd}}', 'x', 'g')) AS template,
  regexp_replace(sent_text, '[\\s\\p{{Z}}\\x{{85}}\\x0b]+', '', 'g') AS dense FROM reflow_rows""",

    "char_set_ops": """WITH s AS (SELECT conv_id, list_distinct(regexp_extract_all(coalesce(latest_message, ''), '(?s).')) AS a, list_distinct(regexp_extract_all(coalesce(sop_l2, ''), '(?s).')) AS b FROM tagging_corpus)
SELECT conv_id, CAST(len(list_intersect(a, b)) AS INT) AS shared, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INT) AS own, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS either FROM s""",
    "script_variants": f"""WITH s AS (SELECT script_id, {_strip('script_text')} AS t FROM sop_scripts),
v AS (SELECT script_id, list_filter(CASE WHEN contains(t, '<newline>') THEN [{_strip("split_part(t, '<newline>', 1)")}, t] ELSE [t] END, lambda x: x <> '') AS a FROM s)
SELECT script_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS place, unnest(a) AS variant FROM v""",
    "duplicate_judge": f"""SELECT row_order, CASE WHEN {sql_blank('ai_text')} AND {sql_blank('sent_text')} THEN '无AI消息' WHEN {sql_blank('ai_text')} OR {sql_blank('sent_text')} THEN '缺少一条AI消息'
  WHEN regexp_replace(ai_text, '{_W}+', '', 'g') = regexp_replace(sent_text, '{_W}+', '', 'g') THEN '是' ELSE '否' END AS verdict FROM reflow_rows""",
    "case_contexts": f"""WITH {MESSAGES.strip()},
a AS (SELECT m.*, concat(coalesce(speaker, ''), ': ', text) AS line, {SALES} AND text IN (SELECT trim(script_text) FROM sop_scripts) AS anchor FROM msgs m),
c AS (SELECT *, coalesce(speaker = '客户' AND lag(anchor) OVER (PARTITION BY conv_id ORDER BY pos), FALSE) AS cut,
  string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY pos) AS context, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rest FROM a)
SELECT conv_id, pos, context, rest FROM c WHERE cut""",
    "mapped_pairs": "SELECT case_id, array_to_string(list_filter([latest_message, nickname, tags], lambda x: x IS NOT NULL)[1:2], '|') AS pair FROM testset",
    "reply_blocks": f"""WITH {MESSAGES.strip()},
a AS (SELECT *, CASE WHEN {SALES} THEN 's' WHEN speaker = '客户' THEN 'c' ELSE 'o' END AS side, text IN (SELECT trim(script_text) FROM sop_scripts) AS scripted FROM msgs),
r AS (SELECT *, sum(CASE WHEN coalesce(lagged, '') <> side THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM (SELECT *, lag(side) OVER (PARTITION BY conv_id ORDER BY pos) AS lagged, lead(side) OVER (PARTITION BY conv_id ORDER BY pos) AS follow FROM a)),
b AS (SELECT conv_id, run, string_agg('[客户][' || coalesce(ts, '') || ']：' || text, chr(10) ORDER BY pos) AS block, min(pos) AS first_pos, max(pos) AS last_pos, coalesce(arg_max(coalesce(follow, ''), pos) = 's', FALSE) AS closed FROM r WHERE side = 'c' GROUP BY 1, 2),
n AS (SELECT x.conv_id, x.pos, x.text AS script, (SELECT min(y.pos) FROM r y WHERE y.conv_id = x.conv_id AND y.pos > x.pos AND y.side <> 's') AS nxt FROM r x WHERE x.side = 's' AND x.scripted)
SELECT n.conv_id, n.pos, n.script, b.block, b.last_pos, b.closed FROM n JOIN r z ON z.conv_id = n.conv_id AND z.pos = n.nxt AND z.side = 'c' JOIN b ON b.conv_id = z.conv_id AND b.run = z.run""",
    "sync_latest_message": f"""WITH l AS (SELECT conv_id, latest_message, list_filter(list_transform(string_split_regex(coalesce(final_context, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_strip('x')}), lambda x: x <> '') AS a FROM tagging_corpus),
e AS (SELECT conv_id, latest_message, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM l),
h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\[[^\\]]+\\]') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS chunk, contains(line, '[客户]') AS named FROM e),
f AS (SELECT *, min(CASE WHEN named THEN i END) OVER (PARTITION BY conv_id, chunk) AS start FROM h),
b AS (SELECT conv_id, chunk, string_agg(line, chr(10) ORDER BY i) AS block FROM f WHERE i >= start GROUP BY 1, 2),
k AS (SELECT conv_id, arg_max(block, chunk) AS block FROM b GROUP BY 1)
SELECT t.conv_id, coalesce(k.block, '') AS block, coalesce(k.block, '') <> '' AND k.block IS DISTINCT FROM t.latest_message AS changed FROM tagging_corpus t LEFT JOIN k USING (conv_id)""",
    "last_two_customer": f"""WITH {MESSAGES.strip()},
e AS (SELECT *, max(CASE WHEN coalesce(speaker, '') <> '客户' THEN pos END) OVER (PARTITION BY conv_id) AS brk, max(pos) OVER (PARTITION BY conv_id) AS hi FROM msgs),
b AS (SELECT conv_id, string_agg(text, '|' ORDER BY pos) AS texts FROM e WHERE (brk IS NULL OR pos > brk) AND pos > hi - 2 GROUP BY conv_id)
SELECT t.conv_id, coalesce(texts, '') AS texts FROM tagging_corpus t LEFT JOIN b USING (conv_id)""",
    "transcript_chunks": """WITH k AS (SELECT file_id, CAST(floor((msg_id - 1) / 1000) AS INT) AS chunk, msg_id, coalesce(message_type = 'image', FALSE) AS image,
  coalesce(sender_role, '') || ': ' || CASE WHEN message_type = 'image' THEN coalesce(file_url, '') ELSE coalesce(processed_text, '') END AS line FROM chat_messages WHERE file_id IS NOT NULL AND msg_id IS NOT NULL),
o AS (SELECT file_id, chunk, msg_id, min(struct_pack(line := line, image := image)) AS m FROM k GROUP BY 1, 2, 3)
SELECT file_id, chunk, string_agg(m.line, chr(10) ORDER BY msg_id) AS "full", coalesce(string_agg(m.line, chr(10) ORDER BY msg_id) FILTER (WHERE NOT m.image), '') AS plain FROM o GROUP BY 1, 2""",
}
