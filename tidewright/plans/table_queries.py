"""Queries over documents, conversations, labels, embeddings and the order tables, each with a DuckDB twin where SQL allows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import answers, numbers, text
from tidewright.operators import joins, selection
from tidewright.plans import checks, evaluation, scoring
from tidewright.scratch import shared_dir
from tidewright.session import table

FENCE = "```"


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", answers.split_of(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("split"))
    return docs.groupBy("split").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").alias("sum_doc"))


def id_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.reconcile({"documents": table(spark, sf_dir, "documents"), "labels": table(spark, sf_dir, "labels")}, "doc_id").select("doc_id", "in_documents", "in_labels")


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.short_text(t, 40).alias("short_text"), text.ellipsis_text(t, 30).alias("ellipsis_text"), F.length(text.normalized_text(t)).cast("bigint").alias("normalized_length"),
        F.md5(text.safe_id(t)).alias("safe_id"), F.md5(text.canonical_text(t)).alias("canonical_text"),
    )


def enum_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("Vote", "He said: Claim", "a body", "Task list", "route-Move", "meeting", "nothing")])
    labels = F.array(*[F.lit(x) for x in (" Route ", "death", "has-contradictory visual evidence", "TRUE", "not enough info", "Unknown", "body")])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(words, (F.col("conv_id") % 7 + 1).cast("int")).alias("w"), F.element_at(labels, (F.col("turn") % 7 + 1).cast("int")).alias("l"))
    return rows.select("conv_id", "turn", text.event_category(F.col("w"), F.lit("")).alias("category"), text.normalize_label(F.col("l")).alias("label"), text.normalize_enum(F.col("l")).alias("enum"))


def choice_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer letters of texts made from turns: stated, optioned, loose or leading letters, think tags and markers."""
    letter = F.char((F.col("conv_id") % 4 + 65).cast("int"))
    other = F.char(((F.col("conv_id") + 1) % 4 + 65).cast("int"))
    m = F.col("turn") % 6
    raw = (
        F.when(m == 0, F.concat(F.lit("I weigh option "), other, F.lit(". Final answer is "), letter)).when(m == 1, F.concat(letter, F.lit(") because of it")))
        .when(m == 2, F.concat(F.lit("<think>answer "), other, F.lit("</think> Choice "), letter)).when(m == 3, F.concat(F.lit("user\nB?\nassistant:\nthe answer: "), letter, F.lit("\nuser\nthanks "), other))
        .when(m == 4, F.lit("no letter here")).otherwise(F.concat(F.lit("maybe "), other, F.lit(" or rather "), letter))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.extract_choice(raw).alias("choice"))


def json_fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"id": '), F.col("conv_id").cast("string"), F.lit(', "turn": '), F.col("turn").cast("string"), F.lit("}"))
    m = F.col("turn") % 4
    raw = F.when(m == 0, F.concat(F.lit(f"Here:\n{FENCE}json\n"), body, F.lit(f"\n{FENCE}\nDone"))).when(m == 1, F.concat(F.lit(f"{FENCE}\n"), body)).when(m == 2, body).otherwise(F.concat(F.lit("so "), body, F.lit(" it is")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.strip_fences(raw).alias("stripped"))
    parsed = answers.parse_answer(F.col("stripped"))
    return rows.withColumn("p", parsed).select("conv_id", "turn", "stripped", answers.field(F.col("p.parsed"), "id", "bigint").alias("parsed_id"), F.col("p.parse_ok").alias("parse_ok"))


def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit('[{"id": '), F.col("conv_id").cast("string"), F.lit(', "t": "a}b\\"{"}, {"id": 2}, {"id":')).alias("raw"))
    return rows.select("conv_id", "turn", F.size(answers.recover_array(F.col("raw"))).alias("n_recovered"), F.to_json(answers.recover_objects(F.col("raw"))).alias("partial"), answers.recover_object(F.col("raw")).alias("first_object"))


def leakage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages, of any length, that documents contain as whole words."""
    return checks.passages_in(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def public_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks - heads and tails of benchmark passages, cut anywhere - that turns of conversations and documents contain."""
    items = table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.substring("text", 1, 9), F.expr("right(text, 14)"), F.expr("substring(text, 20, 5)"), F.expr("substring(text, 40, 2)"))).alias("mark"))
    said = table(spark, sf_dir, "conversations").select(F.format_string("turn %d %d", "conv_id", "turn").alias("key"), "text")
    lines = said.unionByName(table(spark, sf_dir, "documents").select(F.format_string("document %d", "doc_id").alias("key"), "text"))
    return checks.leak_scan(lines, "public", "key", "text", items)


def task_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("trial_id"))
    planned = evaluation.plan(tasks, evaluation.registry(spark), evaluation.modalities(spark), "v1")
    return planned.groupBy("model", "modality").agg(F.count("*").alias("n_tasks"), F.count_if("supported").alias("n_supported"), F.min("task_key").alias("first_key"))


def antijoin_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("task_key"), "conv_id", "turn")
    done = conv.select("task_key", F.when(F.col("conv_id") % 3 == 0, "ok").when(F.col("conv_id") % 3 == 1, "error").otherwise("skipped").alias("status")).where("turn % 2 = 0")
    return joins.anti_completed(conv, done).select("task_key")


def _probe_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to four probe letters a conversation, some wrong, some broken, some citing what they mustn't."""
    conv = table(spark, sf_dir, "conversations").where("turn < 4").select("conv_id", "turn")
    c, t = F.col("conv_id"), F.col("turn")
    yes = lambda cond: F.when(cond, "true").otherwise("false")
    body = (
        F.when(t == 0, F.concat(F.lit('{"knows_truth": '), yes(c % 2 == 0), F.lit(', "belief_label": "belief '), (c % 3).cast("string"), F.lit('", "evidence_ids": ["ev_1"'), F.when(c % 5 == 0, ', "bad_1"').otherwise(""), F.lit("]}")))
        .when(t == 1, F.concat(F.lit('{"target_knew_truth_at_cutoff": '), yes(c % 3 == 0), F.lit(', "belief_label": "belief '), (c % 2).cast("string"), F.lit('"}')))
        .when(t == 2, F.concat(F.lit('so {"other_player_knew_truth_at_cutoff": '), yes(c % 4 == 0), F.when(c % 2 == 0, ', "other_player_likely_belief": "x"').otherwise(""), F.lit("} end")))
        .otherwise(F.when(c % 6 == 0, F.lit("not json")).otherwise(F.concat(F.lit('{"listener": "p1", "predicted_trust_update": "down", "claim_truth_global": "'), F.when(c % 2 == 0, "true").otherwise("False"), F.lit('"}'))))
    )
    return conv.select(F.col("conv_id").alias("probe_group_id"), F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (t + 1).cast("int")).alias("probe_type"), body.alias("raw_response"), t.alias("seq"))


def diagnostic_pivot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = scoring.answer_table(_probe_answers(spark, sf_dir))
    ids = lambda *x: F.array(*[F.lit(v) for v in x])
    gold = groups.withColumns({"forbidden": ids("bad_1"), "acceptable": ids("ev_1"), "expected_global": F.lit("supported"), "expected_local": F.lit(None).cast("string"), "ref_listener": F.when(F.col("probe_group_id") % 2 == 0, "p1").otherwise("p2"), "ref_speaker": F.lit(None).cast("string")})
    return scoring.diagnostic_rates(scoring.score_groups(gold)).select("groups_scored", *[F.round(c, 6).alias(c) for c in ("RC_weak", "FB_weak", "FB_strong", "PT_weak", "claim_verification_global", "perspective_leakage", "evidence_support", "json_parse_success", "schema_validation_success")])


def agentic_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of label-driven answers: predictions are right where quality is 1, and cite what they mustn't if toxic."""
    rows = table(spark, sf_dir, "labels")
    fam = F.element_at(F.array(*[F.lit(x) for x in ("E_hidden", "F_action", "G_next", "H_state")]), (F.col("doc_id") % 4 + 1).cast("int"))
    right = F.col("quality") == 1
    said = F.when(right, "vote").otherwise("task")
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"oracle_guess": {"event_type": "'), said, F.lit('"}, "evidence_ids": ["'), F.when(F.col("toxic") == 1, "bad").otherwise("ok"), F.lit('"]}')))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"predicted_action": "'), said, F.lit('"}'))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"top1_next_behavior": "'), said, F.lit('", "topk_next_behaviors": ["vote"]}')))
        .otherwise(F.concat(F.lit('{"global_truth_guess": "'), said, F.lit('", "local_knowability": "not enough information"}')))
    )
    vote = lambda k: F.when(F.col("doc_id") % 4 == k, "vote")
    asked = rows.select(F.col("doc_id").alias("trial_id"), fam.alias("probe_family"), raw.alias("raw_response"), F.array(F.lit("ok")).alias("acceptable"), F.array(F.lit("bad")).alias("forbidden"), vote(0).alias("gold_event"), vote(1).alias("gold_action"), vote(2).alias("gold_future"), vote(3).alias("gold_truth"), F.when(F.col("doc_id") % 4 == 3, "cannot_know").alias("gold_local"))
    s = scoring.agentic_summary(scoring.agentic_scores(asked))
    return s.select("probe_family", "n_rows", *[F.round(c, 6).alias(c) for c in ("hidden_world_state_accuracy", "next_behavior_top1_accuracy", "next_behavior_topk_accuracy", "deception_detection_global", "deception_awareness_local", "pov_evidence_support", "oracle_overclaim_rate", "composite")])


def mcnemar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    a = rows.select("doc_id", (F.col("quality") == 1).alias("correct"))
    b = rows.select("doc_id", ((F.col("toxic") == 0) & (F.col("doc_id") % 3 > 0)).alias("correct"))
    return scoring.mcnemar(a, b, "doc_id", "correct").select("a_only", "b_only", F.round("statistic", 6).alias("statistic"))


def split_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return scoring.split_accuracy(rows.withColumn("correct", F.col("quality") == 1), "lang", "correct")


def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken constraints of the order tables by check and code."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber")
    ev = table(spark, sf_dir, "events")
    parts = [
        checks.issues(li, "lineitem", key, [("large_discount", F.col("l_discount") > 0.09), ("late_return", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")), ("quantity_range", ~F.col("l_quantity").between(1, 49))]),
        checks.duplicate_keys(li, "lineitem", "l_orderkey", "many_lines"), checks.missing_parent(o, "orders", "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey", "o_orderkey", "customer_in_debt"),
        checks.issues(ev, "events", F.col("event_id"), [("zero_value", F.col("value") < 0.5), ("unknown_type", ~F.col("event_type").isin("click", "view", "purchase", "signup"))]),
    ]
    return checks.report(parts).groupBy("check", "code").agg(F.count("*").alias("n_issues"), F.min("key").alias("first_key"))


def round_robin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return selection.round_robin(o, "o_orderpriority", kinds, "o_totalprice", 60, ["o_orderkey"]).select("o_orderkey", "o_orderpriority", F.col("position").cast("bigint").alias("position"))


def per_stratum_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.per_stratum(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    base = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("base_id"), F.col("v").alias("b"))
    return joins.dots(v, base, "vec_id", "base_id", "v", "b").select("vec_id", "base_id", F.round("dot", 4).alias("dot"))


def graded_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority")
    levels = [("exact", seen, ["o_orderkey"]), ("semantic", seen, ["o_custkey", "o_orderpriority"]), ("loose", seen, ["o_custkey"])]
    return joins.graded_match(o, levels).groupBy("status").agg(F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first_order"))


def expand_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_custkey") + 1, F.col("o_custkey"), F.lit(-1).cast("bigint"), F.col("o_custkey") - 1).alias("ids"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    out = joins.expand_ids(rows, "ids", cust, "c_custkey", "o_orderkey", "found")
    return out.select("o_orderkey", F.array_join(F.transform("found", lambda r: F.concat_ws(":", r["c_custkey"].cast("string"), r["c_mktsegment"])), ",").alias("found"))


def cover_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that aren't pending against reviews, which are the returned lines: missing, duplicate and unexpected ones."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    reviews = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.cover_once(o, reviews, "o_orderkey")


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("high", "低", "0.7", "7", "-1", "", "medium", "00:17:00", "1:30", "score 62.5")]), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", numbers.certainty(raw).alias("certainty"), numbers.protocol_seconds(raw).alias("seconds"), numbers.nearest_bucket(raw).cast("bigint").alias("bucket"), numbers.percent(F.col("event_id") % 7, F.col("event_id") % 3).alias("percent"))


def _money(name: str, digits: int = 12) -> Column:
    """A price as a decimal, so that sums don't depend on the order of rows."""
    return F.col(name).cast(f"decimal({digits},2)")


def _net() -> Column:
    return _money("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - _money("l_discount", 4))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(_net()).cast("double").alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n_lines"))


def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way join with both filters at the scans; revenue by market segment and year."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    j = c.select("c_custkey", "c_mktsegment").join(o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("c_custkey") == F.col("o_custkey")).join(li.select("l_orderkey", "l_extendedprice", "l_discount"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("c_mktsegment", F.year("o_orderdate").cast("bigint").alias("year")).agg(F.sum(_net()).cast("double").alias("revenue"), F.count("*").alias("n_lines"))


def nation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n_customers"), F.sum(_money("c_acctbal")).cast("double").alias("balance"))


def cube_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.grouping_id().cast("bigint").alias("level"))


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumns({"rn": F.row_number().over(w), "prior_price": F.lag("o_totalprice").over(w), "total": F.sum(_money("o_totalprice")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), "quart": F.ntile(4).over(w)})
    return o.where("rn <= 3").select("o_orderkey", "o_custkey", F.col("rn").cast("bigint").alias("rn"), "prior_price", "total", F.col("quart").cast("bigint").alias("quart"))


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def priority_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    who = lambda p: o.where(F.col("o_orderpriority") == p).select("o_custkey")
    both = who("1-URGENT").intersect(who("5-LOW")).withColumn("kind", F.lit("both"))
    only = who("1-URGENT").subtract(who("5-LOW")).withColumn("kind", F.lit("urgent_only"))
    return both.unionByName(only).groupBy("kind").agg(F.count("*").alias("n_customers"), F.sum("o_custkey").alias("sum_keys"))


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, blank ones as unknown, with languages per source."""
    d = table(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("source")))
    name = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    return d.groupBy(name.alias("source")).agg(F.count("*").alias("n_docs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


def missing_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    return selection.missing_from(table(spark, sf_dir, "conversations"), "conv_id", "role", roster).select("conv_id", F.array_join("missing", ",").alias("missing"))


def stream_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows by a streaming query that reads what is there and stops; each batch's result is a commit of the table."""
    from tidewright.streaming import twins

    schema = table(spark, sf_dir, "events").schema
    stream = twins.read_events(spark, f"{sf_dir}/events.parquet*", schema)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = twins.chunk_counts(stream, "ts", "6 hours", "1 day", ["event_type"])
    root = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"
    out = twins.run_complete(counted, f"{root}/table", f"{root}/checkpoint")
    return out.select((F.unix_seconds("window_start")).alias("window_start"), "event_type", "n_events")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch sessions of each user with a gap of an hour."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    from tidewright.streaming import twins

    out = twins.session_counts(ev, "ts", "1 hour", "1 day", ["user_id"])
    return out.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n_events").alias("largest"))


QUERIES = {f.__name__: f for f in (
    hash_split, id_reconciliation, text_scalars, enum_ladders, choice_extraction, json_fence_strip, json_recover, leakage_scan, public_leaks, task_grid, antijoin_resume,
    diagnostic_pivot_scores, agentic_composite, mcnemar_pairs, split_accuracy, issue_report, round_robin_topk, per_stratum_topk, vector_dot, graded_match,
    expand_ids, cover_once, number_words, pricing_summary, segment_revenue, nation_rollup, cube_status, order_ranks, customers_without_orders, priority_sets,
    value_counts, missing_roles, stream_chunk_counts, session_windows,
)}

_SPLIT = "CAST(('0x' || substr(sha256('doc_' || doc_id), 1, 8)) AS BIGINT) % 10"

ORACLE_SQL = {
    "hash_split": f"""WITH h AS (SELECT doc_id, {_SPLIT} AS v FROM documents)
        SELECT CASE WHEN v < 7 THEN 'train' WHEN v < 9 THEN 'dev' ELSE 'test' END AS split, count(*) AS n_docs, min(doc_id) AS first_doc, CAST(sum(doc_id) AS BIGINT) AS sum_doc FROM h GROUP BY 1""",
    "id_reconciliation": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_documents, l.doc_id IS NOT NULL AS in_labels
        FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
    "text_scalars": r"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM documents)
        SELECT doc_id, CASE WHEN substr(regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g'), 1, 40) = '' THEN 'unknown' ELSE substr(regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g'), 1, 40) END AS short_text,
               CASE WHEN length(flat) > 30 THEN substr(flat, 1, 29) || '…' ELSE flat END AS ellipsis_text, length(regexp_replace(lower(text), '\s+', '', 'g')) AS normalized_length,
               md5(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS safe_id,
               md5(lower(regexp_replace(regexp_replace(regexp_replace(text, '["''“”‘’]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS canonical_text FROM d""",
    "enum_ladders": """WITH r AS (SELECT conv_id, turn, lower(['Vote', 'He said: Claim', 'a body', 'Task list', 'route-Move', 'meeting', 'nothing'][conv_id % 7 + 1]) AS w,
               [' Route ', 'death', 'has-contradictory visual evidence', 'TRUE', 'not enough info', 'Unknown', 'body'][turn % 7 + 1] AS l FROM conversations),
        n AS (SELECT *, translate(lower(trim(l)), '- ', '__') AS k FROM r)
        SELECT conv_id, turn, CASE WHEN contains(w, 'vote') THEN 'vote' WHEN contains(w, 'claim') THEN 'speech_response' WHEN contains(w, 'body') THEN 'kill_related' WHEN contains(w, 'task') THEN 'task'
               WHEN contains(w, 'route') THEN 'location' WHEN contains(w, 'meeting') THEN 'meeting_strategy' ELSE 'unknown' END AS category,
               CASE k WHEN 'route' THEN 'location' WHEN 'death' THEN 'kill_related' WHEN 'body' THEN 'kill_related' WHEN 'has_contradictory_visual_evidence' THEN 'knows' ELSE k END AS label,
               CASE k WHEN 'true' THEN 'supported' WHEN 'not_enough_info' THEN 'not_enough_information' ELSE k END AS enum FROM n""",
    "choice_extraction": "SELECT conv_id, turn, CASE WHEN turn % 6 = 4 THEN '' ELSE chr(CAST(conv_id % 4 + 65 AS INTEGER)) END AS choice FROM conversations",
    "json_fence_strip": """WITH b AS (SELECT conv_id, turn, '{"id": ' || conv_id || ', "turn": ' || turn || '}' AS body FROM conversations)
        SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'so ' || body || ' it is' ELSE body END AS stripped, conv_id AS parsed_id, true AS parse_ok FROM b""",
    "leakage_scan": r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents), b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS passage FROM benchmark)
        SELECT doc_id, item_id FROM d JOIN b ON passage <> '' AND contains(' ' || body || ' ', ' ' || passage || ' ')""",
    "public_leaks": """WITH m AS (SELECT DISTINCT unnest([substring(text, 1, 9), right(text, 14), substring(text, 20, 5), substring(text, 40, 2)]) AS detail FROM benchmark),
        l AS (SELECT printf('turn %d %d', conv_id, turn) AS key, text FROM conversations UNION ALL SELECT printf('document %d', doc_id), text FROM documents)
        SELECT 'public' AS check, 'public_leak' AS code, key, detail FROM l JOIN m ON contains(text, detail) WHERE detail <> ''""",
    "task_grid": """WITH m(model, inputs) AS (VALUES ('mock-text', ['text']), ('mock-vision', ['text', 'image', 'video']), ('mock-omni', ['text', 'image', 'video', 'audio'])),
        k(modality, needs) AS (VALUES ('text', ['text']), ('video', ['text', 'video']), ('audio_video', ['text', 'video', 'audio']))
        SELECT model, modality, count(*) AS n_tasks, count(*) FILTER (list_has_all(inputs, needs)) AS n_supported, min(conv_id || '-' || turn || '|' || model || '|' || modality || '|v1') AS first_key
        FROM conversations CROSS JOIN m CROSS JOIN k WHERE role = 'user' GROUP BY model, modality""",
    "antijoin_resume": "SELECT conv_id || '-' || turn AS task_key FROM conversations WHERE NOT (turn % 2 = 0 AND conv_id % 3 <> 1)",
    "diagnostic_pivot_scores": """WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE turn < 4),
        h AS (SELECT conv_id, count(*) FILTER (turn = 0) > 0 AS a, count(*) FILTER (turn = 1) > 0 AS b, count(*) FILTER (turn = 2) > 0 AS c, count(*) FILTER (turn = 3) > 0 AS d FROM conversations GROUP BY conv_id),
        s AS (SELECT c.conv_id AS g, a, b, h.c AS cc, d, d AND g % 6 <> 0 AS dok FROM c JOIN h USING (conv_id))
        SELECT count(*) AS groups_scored, round(count(*) FILTER (b AND g % 3 <> 0) / count(*), 6) AS RC_weak, round(count(*) FILTER (cc AND g % 4 <> 0) / count(*), 6) AS FB_weak,
               round(count(*) FILTER (cc AND g % 4 <> 0 AND g % 2 = 0) / count(*), 6) AS FB_strong, round(count(*) FILTER (dok AND g % 2 = 0) / count(*), 6) AS PT_weak,
               round(count(*) FILTER (dok AND g % 2 = 0) / count(*), 6) AS claim_verification_global, round(count(*) FILTER (a AND g % 5 = 0) / count(*), 6) AS perspective_leakage,
               round(count(*) FILTER (NOT (a AND g % 5 = 0)) / count(*), 6) AS evidence_support, round(count(*) FILTER (NOT (d AND g % 6 = 0)) / count(*), 6) AS json_parse_success,
               round(count(*) FILTER (NOT (d AND g % 6 = 0) AND NOT (cc AND g % 2 = 1)) / count(*), 6) AS schema_validation_success FROM s""",
    "agentic_composite": """WITH r AS (SELECT doc_id % 4 AS f, quality = 1 AS ok, toxic = 1 AS bad FROM labels),
        a AS (SELECT CASE WHEN grouping(f) = 1 THEN '(all)' ELSE ['E_hidden', 'F_action', 'G_next', 'H_state'][f + 1] END AS probe_family, count(*) AS n_rows, avg(CASE WHEN f = 0 THEN CAST(ok AS INT) END) AS e, avg(CASE WHEN f = 2 THEN CAST(ok AS INT) END) AS g,
               avg(CASE WHEN f = 2 THEN 1 END) AS gk, avg(CASE WHEN f = 3 THEN CAST(ok AS INT) END) AS h, avg(CASE WHEN f = 3 THEN 1 END) AS hl, avg(CAST(NOT (f = 0 AND bad) AS INT)) AS p, avg(CAST(f = 0 AND bad AS INT)) AS o FROM r GROUP BY GROUPING SETS ((), (f)))
        SELECT probe_family, n_rows, round(e, 6) AS hidden_world_state_accuracy, round(g, 6) AS next_behavior_top1_accuracy, round(gk, 6) AS next_behavior_topk_accuracy, round(h, 6) AS deception_detection_global,
               round(hl, 6) AS deception_awareness_local, round(p, 6) AS pov_evidence_support, round(o, 6) AS oracle_overclaim_rate,
               round(0.25 * coalesce(e, 0) + 0.20 * coalesce(g, 0) + 0.15 * coalesce(h, 0) + 0.15 * coalesce(hl, 0) + 0.10 * p + 0.10 * (1 - o) + 0.025, 6) AS composite FROM a""",
    "mcnemar_pairs": """WITH r AS (SELECT quality = 1 AS a, toxic = 0 AND doc_id % 3 > 0 AS b FROM labels), n AS (SELECT count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (NOT a AND b) AS b_only FROM r)
        SELECT a_only, b_only, round(coalesce(pow(abs(a_only - b_only) - 1, 2) / nullif(a_only + b_only, 0), 0.0), 6) AS statistic FROM n""",
    "split_accuracy": """SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) FILTER (quality = 1) AS n_correct, count(*) AS n_total, round(count(*) FILTER (quality = 1) / count(*), 6) AS accuracy
        FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""",
    "issue_report": """WITH i AS (
        SELECT 'lineitem' AS "check", 'large_discount' AS code, l_orderkey || '|' || l_linenumber AS key FROM lineitem WHERE l_discount > 0.09 UNION ALL
        SELECT 'lineitem', 'late_return', l_orderkey || '|' || l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' UNION ALL
        SELECT 'lineitem', 'quantity_range', l_orderkey || '|' || l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 49 UNION ALL
        SELECT 'lineitem', 'many_lines', CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 UNION ALL
        SELECT 'orders', 'customer_in_debt', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL
        SELECT 'events', 'zero_value', CAST(event_id AS VARCHAR) FROM events WHERE value < 0.5 UNION ALL
        SELECT 'events', 'unknown_type', CAST(event_id AS VARCHAR) FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup'))
        SELECT "check", code, count(*) AS n_issues, min(key) AS first_key FROM i GROUP BY ALL""",
    "round_robin_topk": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
        t AS (SELECT *, rn <= 8 AS f FROM n ORDER BY NOT f, CASE WHEN f THEN rn END, CASE WHEN f THEN o_orderpriority END, o_totalprice DESC, o_orderkey LIMIT 60)
        SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY NOT f, CASE WHEN f THEN rn END, CASE WHEN f THEN o_orderpriority END, o_totalprice DESC, o_orderkey) - 1 AS position FROM t""",
    "per_stratum_topk": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    "vector_dot": """SELECT v.vec_id, b.vec_id AS base_id, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 4) + 0.0 AS dot
        FROM embeddings v CROSS JOIN embeddings b WHERE b.vec_id % 100 = 0""",
    "graded_match": """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), s AS (
        SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM f) THEN 'exact' WHEN (o_custkey, o_orderpriority) IN (SELECT o_custkey, o_orderpriority FROM f) THEN 'semantic'
               WHEN o_custkey IN (SELECT o_custkey FROM f) THEN 'loose' ELSE 'none' END AS status FROM orders) SELECT status, count(*) AS n_orders, min(o_orderkey) AS first_order FROM s GROUP BY status""",
    "expand_ids": """WITH o AS (SELECT o_orderkey, unnest([o_custkey + 1, o_custkey, -1, o_custkey - 1]) AS c_custkey, unnest([1, 2, 3, 4]) AS pos FROM orders)
        SELECT o_orderkey, coalesce(string_agg(c_custkey || ':' || c_mktsegment, ',' ORDER BY pos) FILTER (c_mktsegment IS NOT NULL), '') AS found FROM o LEFT JOIN customer USING (c_custkey) GROUP BY o_orderkey""",
    "cover_once": """WITH r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), o AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'),
        b AS (SELECT coalesce(o.k, r.k) AS o_orderkey, CASE WHEN o.k IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' END AS code FROM o FULL JOIN r ON o.k = r.k)
        SELECT o_orderkey, code FROM b WHERE code IS NOT NULL""",
    "number_words": """SELECT event_id, CAST([0.85, 0.35, 0.7, 1.0, 0.0, 0.5, 0.6, 0.5, 0.5, 0.5][event_id % 10 + 1] AS DOUBLE) AS certainty, CAST([0.0, 0.0, 0.7, 7.0, -1.0, 0.0, 0.0, 17.0, 90.0, 0.0][event_id % 10 + 1] AS DOUBLE) AS seconds,
        CAST([0, 0, 0, 0, 0, 0, 0, 0, 0, 50][event_id % 10 + 1] AS BIGINT) AS bucket, CASE WHEN event_id % 3 = 0 THEN '0.00%' ELSE printf('%.2f%%', (event_id % 7) / (event_id % 3) * 100.0) END AS percent FROM events""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n_lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "segment_revenue": """SELECT c_mktsegment, year(o_orderdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue, count(*) AS n_lines
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL""",
    "nation_rollup": "SELECT r_name, n_name, count(*) AS n_customers, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "cube_status": "SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, grouping(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "order_ranks": """WITH w AS (SELECT o_orderkey, o_custkey, row_number() OVER w AS rn, lag(o_totalprice) OVER w AS prior_price, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total, ntile(4) OVER w AS quart
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) SELECT * FROM w WHERE rn <= 3""",
    "customers_without_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "priority_sets": """WITH u AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), l AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'),
        s AS (SELECT 'both' AS kind, o_custkey FROM (FROM u INTERSECT FROM l) UNION ALL SELECT 'urgent_only', o_custkey FROM (FROM u EXCEPT FROM l))
        SELECT kind, count(*) AS n_customers, CAST(sum(o_custkey) AS BIGINT) AS sum_keys FROM s GROUP BY kind""",
    "value_counts": """SELECT CASE WHEN doc_id % 10 = 0 THEN 'unknown' ELSE source END AS source, count(*) AS n_docs, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1""",
    "missing_roles": """WITH r AS (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id)
        SELECT conv_id, array_to_string(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(roles, x)), ',') AS missing FROM r""",
    "stream_chunk_counts": """SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS window_start, event_type, count(*) AS n_events FROM events GROUP BY ALL""",
    "session_windows": """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l), n AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY ALL)
        SELECT user_id, count(*) AS n_sessions, max(n) AS largest FROM n GROUP BY user_id""",
}
