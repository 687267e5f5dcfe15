"""The programs by id: what each needs, its parameters, and the tables it gives.

``run(spark, id, inputs, params)`` is the one way in; a service or a command line would only wrap it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import questions, text
from dialoom.functions.blank import is_blank, strip
from dialoom.operators import compliance, dialogue, payload, propagation, reports, sampling, scripts, tagging
from dialoom.session import ensure_checkpoint_dir, ship
from dialoom.sources import files

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Parameter:
    """A parameter's type and default; text values are converted, empty ones mean the default."""

    kind: type
    default: Any = None

    def value(self, given: Any) -> Any:
        if given is None or given == "":
            return self.default
        if self.kind is bool and isinstance(given, str):
            return given.strip().lower() in ("1", "true", "yes", "y", "是")
        return self.kind(given)


@dataclass(frozen=True)
class Program:
    """A registered program."""

    id: str
    inputs: tuple[str, ...]
    run: Callable[[SparkSession, Tables, dict], Tables]
    parameters: dict[str, Parameter] = field(default_factory=dict)
    about: str = ""


PROGRAMS: dict[str, Program] = {}


def program(inputs: tuple[str, ...], **parameters: Parameter):
    def keep(run: Callable) -> Callable:
        PROGRAMS[run.__name__] = Program(run.__name__, inputs, run, parameters, (run.__doc__ or "").strip())
        return run

    return keep


def run(spark: SparkSession, program_id: str, inputs: Tables, params: dict | None = None) -> Tables:
    """Run a program: unknown ids, missing inputs and unknown parameters are errors."""
    if program_id not in PROGRAMS:
        raise KeyError(f"no program {program_id}; there are {', '.join(sorted(PROGRAMS))}")
    ship(spark)
    p, params = PROGRAMS[program_id], params or {}
    if missing := [i for i in p.inputs if i not in inputs]:
        raise ValueError(f"{program_id} needs the tables {', '.join(missing)}")
    if unknown := set(params) - set(p.parameters):
        raise ValueError(f"{program_id} has no parameters {', '.join(sorted(unknown))}")
    return p.run(spark, inputs, {k: v.value(params.get(k)) for k, v in p.parameters.items()})


@program(("rows", "schema"), target=Parameter(int, 400))
def process_reflow(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """Log rows to a customer data set: trimmed, labels filled both ways, payloads by time, a proportional sample."""
    trimmed = propagation.trim_to_last_reply(t["rows"])
    filled = propagation.fill_forward(propagation.fill_back(trimmed, t["schema"]).drop("backfilled")).drop("filled")
    named = propagation.enrich(filled, t["schema"]).withColumns({"sop_l1": F.col("l1"), "sop_l2": F.col("l2")}).drop("l1", "l2")
    paid = propagation.payloads_by_time(named)
    customers = paid.filter(F.col("sender") == propagation.CUSTOMER).withColumns({
        "conversation": dialogue.complete(F.col("history"), F.col("message"), F.col("message_time")), "is_question": questions.is_question_quoted(F.col("message")),
    }).filter(~is_blank(F.col("history")) & ~is_blank(F.col("message")) & ~is_blank(F.col("sop_l2")))
    sizes = customers.filter(~is_blank(F.col("sop_l1"))).groupBy(F.col("sop_l1").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    quotas = sampling.largest_remainder(sizes, p["target"])
    return {"rows": named, "customers": customers, "distribution": sizes, "quotas": quotas, "sample": sampling.draw(customers, "sop_l1", quotas, "row_order")}


@program(
    ("conversations", "scripts"), similarity_threshold=Parameter(float, 0.6), sequence_threshold=Parameter(float, 0.4), history_column=Parameter(str, "final_context"),
    strong_validation=Parameter(bool, True), strong_threshold=Parameter(float, tagging.STRONG), follow_up_threshold=Parameter(float, tagging.STRONG_FOLLOW_UP),
)
def run_sop_pipeline(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """Conversations tagged with a path of the script tree: the newest message's path, else the best one over all
    messages, carried on from a strongly validated path where there is one; and what each method found."""
    ensure_checkpoint_dir(spark)
    column = files.resolve_column(t["conversations"], [p["history_column"], "history", "final_context"])
    rows = dialogue.messages(t["conversations"].select("conv_id", column), "conv_id", column)
    sales = tagging.until_last_customer(rows, dialogue.is_sales(F.col("speaker")), F.col("speaker") == "客户")
    paths = tagging.path_table(t["scripts"])
    by_path = scripts.best_per_path(scripts.sequence_or_cosine(sales, t["scripts"], p["similarity_threshold"], p["sequence_threshold"]), t["scripts"])
    found = tagging.hits(sales, by_path).checkpoint()
    chosen = tagging.candidates(found, paths).checkpoint()
    base = tagging.base_match(found, chosen, paths)
    validated = tagging.strong(chosen, p["strong_threshold"], p["follow_up_threshold"])
    if not p["strong_validation"]:
        validated = validated.limit(0)
    near = scripts.cosine_matches(sales, t["scripts"], tagging.FILLED)
    whole = tagging.merged(base, validated, sales, near, t["scripts"], scripts.predicted_paths(t["scripts"]))
    told = whole.withColumn("missing", scripts.unmatched_levels(F.col("path"), F.col("levels")))
    return {"tagged": t["conversations"].join(told, "conv_id", "left"), "base": base, "validated": validated}


@program(("conversations", "scripts"), mode=Parameter(str, "both"), similarity_threshold=Parameter(float, 0.6))
def reference_matcher(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """The latest reply that matches a script of the stored node (verify), of any node (infer), or both compared.

    A match is scored by the better of the lexical similarity and the TF-IDF cosine."""
    rows = dialogue.messages(t["conversations"].select("conv_id", "final_context"), "conv_id", "final_context")
    sales = rows.filter(dialogue.is_sales(F.col("speaker"))).select("conv_id", "pos", "ts", "text")
    matches = scripts.composite_matches(sales, t["scripts"], p["similarity_threshold"])
    nodes = t["scripts"].select("script_id", F.col("path")[0].alias("node_1"), F.col("path")[1].alias("node_2"))
    out: Tables = {}
    if p["mode"] in ("verify", "both"):
        out["verified"] = tagging.verify(t["conversations"], sales, matches, t["scripts"])
    if p["mode"] in ("infer", "both"):
        out["inferred"] = scripts.latest_match(sales, matches).join(scripts.small(nodes), "script_id")
    if p["mode"] == "both":
        joined = t["conversations"].select("conv_id", "sop_l1").join(out["inferred"].select("conv_id", "node_1"), "conv_id", "left")
        out["compared"] = joined.select("conv_id", scripts.best_script_verdict(F.col("sop_l1"), F.col("node_1")).alias("verdict"))
    return out


@program(("rows",), column=Parameter(str, "sent_text"))
def extract_expected_utterance_parts(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """Statement and closing question of an utterance column."""
    return {"rows": t["rows"].withColumn("__s", text.split_utterance(F.col(p["column"]))).withColumns({"statement": F.col("__s.statement"), "question": F.col("__s.question")}).drop("__s")}


@program(("rows",))
def preprocess_client_cases(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """Log rows to standard cases: the day's payload, first replies, thought units by equal message, and quality figures."""
    units = propagation.nearest_unused(t["rows"]).select("row_order", "given", "given_by")
    cases = propagation.same_day_payload(t["rows"]).join(units, "row_order", "left")
    replies = propagation.first_reply(t["rows"]).select("row_order", "reply_ai", "reply_sent", "reply_audit")
    standard = cases.join(replies, "row_order", "left").withColumn("history", dialogue.standardise(F.col("history")))
    per_sales = standard.groupBy("sales_id").agg(F.countDistinct("customer_id").alias("customers"), F.count(F.lit(1)).alias("cases"))
    return {"cases": standard, "per_sales": per_sales, "quality": reports.quality_metrics(standard, ["history", "message", "day_rag", "given"], ["sales_id", "customer_id"], ["rag_source"])}


@program(("cases",), total=Parameter(int, 300), guaranteed=Parameter(int, 5))
def select_client_cases(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """A two-phase sample of cases by cycle, with its coverage."""
    cases = t["cases"].filter(~is_blank(F.col("latest_message"))).withColumn("cycle", sampling.cycle_description(F.col("cycle_label")))
    sizes = cases.groupBy(F.col("cycle").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    quotas = sampling.two_phase(sizes, p["total"], p["guaranteed"])
    chosen = sampling.draw(cases, "cycle", quotas, "case_id")
    return {
        "selected": chosen, "quotas": quotas, "coverage": reports.coverage_of(cases, chosen, ["cycle", "sales_id", "message_type"]), "plan": reports.selection_plan(quotas, chosen, "cycle"),
    }


@program(("replies", "patterns"), column=Parameter(str, "sent_text"))
def detect_scripted_replies(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """Replies that follow a pattern (``files.load_patterns``), with it and its score; the number of hits."""
    rows = compliance.annotate(t["replies"], p["column"], t["patterns"])
    return {"rows": rows, "totals": rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_hit").alias("hits"))}


@program(("labels", "schema"))
def map_sop_ids(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """Ids of node labels: equal, else the only longer, else the only shorter name; labels without one apart."""
    mapped = propagation.map_ids(t["labels"], t["schema"])
    twice = t["schema"].groupBy("task_theme", "sub_theme").count().filter("count > 1")
    return {"mapped": mapped.filter("sub_id is not null"), "unresolved": mapped.filter("sub_id is null"), "repeated_keys": twice}


@program((), folder=Parameter(str), pattern=Parameter(str, "*.parquet"), include_source=Parameter(bool, True))
def merge_files(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """All files of a folder as one table, columns aligned by name."""
    return {"merged": files.read_folder(spark, p["folder"], p["pattern"], "source_file" if p["include_source"] else None)}


@program(("rows",), history_column=Parameter(str, "final_context"), message_column=Parameter(str, "latest_message"))
def update_latest_customer_message(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """The stored latest message brought in line with the history's last customer block; the number of changes."""
    block = dialogue.last_customer_block(F.col(p["history_column"]))
    new = F.when(block != "", block).otherwise(F.col(p["message_column"]))
    updated, changed = files.update_column(t["rows"], p["message_column"], new)
    return {"rows": updated, "changes": t["rows"].agg(F.count_if(changed).alias("changed"))}


@program(("cases",))
def clean_bad_cases(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """Cases with clean heads, the history up to the last customer message, and their payload fields."""
    history = dialogue.until_last_customer(dialogue.clean_sales_heads(F.col("history")))
    fields = payload.entry_fields(t["cases"], "case_id")
    labels = payload.unit_labels(t["cases"], "case_id")
    cases = t["cases"].select("case_id", history.alias("history"), "latest_message", questions.is_question_anchored(F.col("latest_message")).alias("question"))
    return {"cases": cases.join(fields, "case_id", "left").join(labels, "case_id", "left")}


@program(("conversations", "scripts"), mode=Parameter(str, "single"))
def cut_cases(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """Customer messages that answer a scripted reply: the one right after it (single), or the run of them (mult)."""
    if p["mode"] not in ("single", "mult"):
        raise ValueError("mode is single or mult")
    known = scripts.small(t["scripts"].select(F.trim("script_text").alias("text")).distinct().withColumn("scripted", F.lit(True)))
    rows = dialogue.messages(t["conversations"].select("conv_id", "final_context"), "conv_id", "final_context").join(known, "text", "left")
    if p["mode"] == "mult":
        return {"cases": dialogue.reply_blocks(rows, F.col("scripted"))}
    anchors = rows.filter(F.col("scripted") & dialogue.is_sales(F.col("speaker"))).select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("text").alias("script"))
    return {"cases": rows.filter(F.col("speaker") == "客户").join(anchors, ["conv_id", "pos"]).select("conv_id", "pos", "script", "text")}


@program(("turns", "replies"))
def map_ai_turns(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """The distinct assistant texts of each customer's turn, joined in order: turns need customer_id, message_time."""
    made = F.upper(strip(F.coalesce("producer", F.lit("")))) == propagation.PRODUCER
    told = t["replies"].filter(made & ~is_blank(F.col("ai_text"))).withColumn("__at", propagation.event_time(F.col("message_time"))).filter("__at is not null")
    first = told.groupBy("customer_id", "__at", F.trim("ai_text").alias("ai_text")).agg(F.min("row_order").alias("n"))
    texts = first.groupBy("customer_id", "__at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "ai_text"))), lambda x: x["ai_text"]), " || ").alias("ai_texts"))
    return {"turns": t["turns"].withColumn("__at", propagation.event_time(F.col("message_time"))).join(texts, ["customer_id", "__at"], "left").drop("__at")}


@program(("replies",), column=Parameter(str, "reply"), most=Parameter(int, 5))
def augment_questions(spark: SparkSession, t: Tables, p: dict) -> Tables:
    """Clean questions from the replies of a language model (any source that gives a text column)."""
    return {"questions": t["replies"].withColumn("question", F.explode(questions.clean_questions(F.col(p["column"]), p["most"])))}
