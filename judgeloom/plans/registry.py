"""The queries of the judge-reliability engine over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import labels as L
from ..functions import uncertainty as U
from ..operators import prompts as P
from ..operators import sampling as S
from ..operators import sinks
from ..operators.consistency import consistency, item_rollup
from ..operators.judge import replayed, requests
from ..schemas import fault
from ..sources.pairs import expand_swaps, load_pairs
from . import expected as X
from . import experiments as E
from . import testbed as T

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: engines differ in the last bits of a sum."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def softmax_probs(spark, sf_dir):
    rows = T.scored(spark, sf_dir)
    return rounded(rows.select("pair_id", *[c.alias(n) for n, c in T.slot(0).items()]))


def logit_metrics(spark, sf_dir):
    rows = T.scored(spark, sf_dir).select("pair_id", *[c.alias(n) for n, c in T.slot(0).items()])
    return rounded(rows.select("pair_id", *[c.alias(n) for n, c in U.logit_metrics(F.col("p_a"), F.col("p_b"), F.col("p_tie")).items()]))


def verbalized_metrics(spark, sf_dir):
    return rounded(T.table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in U.verbalized_metrics(F.col("value")).items()]))


def verdict_argmax(spark, sf_dir):
    rows = T.scored(spark, sf_dir).select("pair_id", *[c.alias(n) for n, c in T.slot(0).items()])
    return rows.select("pair_id", L.argmax_label(F.col("p_a"), F.col("p_b"), F.col("p_tie")).alias("verdict"))


def verdict_parse(spark, sf_dir):
    none = F.lit(None).cast("double")
    return T.table(spark, sf_dir, "documents").select("doc_id", L.parse_verdict(F.col("text"), none, none, none).alias("verdict"))


def consistency_votes(spark, sf_dir):
    return rounded(consistency(T.votes(spark, sf_dir), ["user_id"]))


def consistency_runs(spark, sf_dir):
    return rounded(consistency(T.runs(spark, sf_dir), ["pair_id"]))


def _position(spark, sf_dir):
    rows = T.judged(spark, sf_dir, ["original", "swapped"])
    own = lambda side: F.concat(F.col("pair_id").cast("string"), F.lit(f":response_{side}"))
    swapped = F.col("variant_id") == "swapped"
    return E.position_pairs(rows.withColumns({"response_id_a": F.when(swapped, own("b")).otherwise(own("a")), "response_id_b": F.when(swapped, own("a")).otherwise(own("b"))}))


def position_pair_summary(spark, sf_dir):
    return rounded(_position(spark, sf_dir).drop("source_row_index"))


def position_summary(spark, sf_dir):
    return rounded(E.position_summary(_position(spark, sf_dir)))


def _cues(spark, sf_dir, family):
    rows = T.judged(spark, sf_dir, ["control", f"{family}_congruent", f"{family}_incongruent"]).filter(F.col("human_winner").isin("A", "B"))
    target = F.when(F.col("variant_id").endswith("_congruent"), F.col("human_winner")).when(F.col("variant_id").endswith("_incongruent"), L.opposite_label(F.col("human_winner")))
    return E.cue_pairs(rows.withColumn("cue_target", target), family)


def authority_pair_summary(spark, sf_dir):
    return rounded(_cues(spark, sf_dir, "authority").drop("source_row_index"))


def authority_summary(spark, sf_dir):
    return rounded(E.cue_summary(_cues(spark, sf_dir, "authority"), "authority"))


def bandwagon_summary(spark, sf_dir):
    return rounded(E.cue_summary(_cues(spark, sf_dir, "bandwagon"), "bandwagon"))


def item_aggregate(spark, sf_dir):
    rows = T.judged(spark, sf_dir, ["original", "swapped", "third"])
    records = rows.select(
        F.col("pair_id").cast("string").alias("example_id"), F.col("pair_id").cast("string").alias("question_id"), F.lit("position").alias("bias_name"), F.lit("replay").alias("model_name"),
        "verdict", "entropy", "msp", F.lit(None).cast("double").alias("verbalized_uncertainty"),
    )
    return rounded(item_rollup(records))


def winner_normalize(spark, sf_dir):
    spelled = F.element_at(F.array(*[F.lit(x) for x in (" Model_A ", "2", "right", "EQUAL", "tie (inconsistent)", "", "left", "response_b")]), (F.col("event_id") % 8 + 1).cast("int"))
    return T.table(spark, sf_dir, "events").select("event_id", L.normalize_winner(spelled).alias("winner"))


def pair_swap_expand(spark, sf_dir):
    out = expand_swaps(T.conversation_pairs(spark, sf_dir))
    return out.select("pair_id", "variant_id", "example_id", F.md5(F.col("answer_a").cast("binary")).alias("a_md5"), F.md5(F.col("answer_b").cast("binary")).alias("b_md5"), "response_id_a", "response_id_b", "side_winner")


def condition_matrix(spark, sf_dir):
    return P.conditions(spark)


def conversation_final_response(spark, sf_dir):
    return T.messages(spark, sf_dir).select("conv_id", F.md5(C.final_response(F.col("messages")).cast("binary")).alias("response_md5"))


def shared_prefix(spark, sf_dir):
    rows = T.messages(spark, sf_dir)
    other = F.transform("messages", lambda m, i: F.when(i < 2, m).otherwise(F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("!")).alias("content"))))
    return rows.select("conv_id", F.size(C.shared_prefix(F.col("messages"), other)).alias("n_shared"), F.size(C.prompt_prefix(F.col("messages"), other)).alias("n_prompt"))


def first_user_question(spark, sf_dir):
    return T.messages(spark, sf_dir).select("conv_id", F.md5(C.first_question(F.col("messages")).cast("binary")).alias("question_md5"))


def _prompt(spark, sf_dir, family):
    rows = T.conversation_pairs(spark, sf_dir)
    cue = P.cue("authority", F.when(F.col("human_winner") != "tie", F.col("human_winner"))) if family == "authority" else None
    return rows.select("pair_id", P.chat_prompt(family, F.col("prompt_messages"), F.col("response_a"), F.col("response_b"), cue).alias("prompt_text"))


def position_prompt(spark, sf_dir):
    return _prompt(spark, sf_dir, "position").select("pair_id", F.length("prompt_text").alias("n_chars"), F.md5(F.col("prompt_text").cast("binary")).alias("prompt_md5"))


def authority_prompt(spark, sf_dir):
    return _prompt(spark, sf_dir, "authority").select("pair_id", F.length("prompt_text").alias("n_chars"), F.md5(F.col("prompt_text").cast("binary")).alias("prompt_md5"))


def matrix_prompt(spark, sf_dir):
    rows = T.conversation_pairs(spark, sf_dir).select(F.col("pair_id").alias("example_id"), "prompt_messages", F.col("response_a").alias("answer_a"), F.col("response_b").alias("answer_b"))
    out = P.matrix_prompts(rows, spark)
    return out.select("example_id", "variant_id", "bias_type", F.length("prompt_text").alias("n_chars"), F.md5(F.col("prompt_text").cast("binary")).alias("prompt_md5"))


def prompt_hash(spark, sf_dir):
    rows = T.conversation_pairs(spark, sf_dir).withColumn("cue", P.cue("authority", F.when(F.col("human_winner") != "tie", F.col("human_winner"))))
    text = lambda family, cue: P.chat_prompt(family, F.col("prompt_messages"), F.col("response_a"), F.col("response_b"), cue)
    rows = rows.withColumns({"position_text": text("position", None), "authority_text": text("authority", F.col("cue"))})
    hashed = lambda family, cue: P.chat_hash(family, F.col("pair_id"), F.col(f"{family}_text"), cue)
    return rows.select("pair_id", hashed("position", None).alias("position_hash"), hashed("authority", F.col("cue")).alias("authority_hash"))


def matrix_hash(spark, sf_dir):
    rows = T.conversation_pairs(spark, sf_dir).select(F.col("pair_id").alias("example_id"), "prompt_messages", F.col("response_a").alias("answer_a"), F.col("response_b").alias("answer_b"))
    plain = P.matrix_packages(rows, spark).select("example_id", "variant_id", "prompt_hash")
    pinned = P.matrix_packages(rows, spark, allowed_labels=["A", "B"], extra_metadata={"template": "v2", "round": 3}).select("example_id", "variant_id", F.col("prompt_hash").alias("pinned_hash"))
    return plain.join(pinned, ["example_id", "variant_id"])


def csv_pairs(spark, sf_dir):
    got = load_pairs(spark, T.comparison_csv(spark, sf_dir))
    md5 = lambda c: F.md5(c.cast("binary"))
    return got.select("source_row_index", "pair_id", "turn", "human_winner", "model_a", "model_b", md5(C.rendered(F.col("prompt_messages"))).alias("prompt_md5"), md5(F.col("response_a")).alias("a_md5"), md5(F.col("response_b")).alias("b_md5"))


def csv_conversations(spark, sf_dir):
    got = load_pairs(spark, T.conversation_csv(spark, sf_dir))
    return got.select("pair_id", F.size("prompt_messages").alias("n_prompt"), F.md5(C.rendered(F.col("prompt_messages")).cast("binary")).alias("prompt_md5"), F.md5(F.col("response_a").cast("binary")).alias("a_md5"), "response_b")


def csv_limit(spark, sf_dir):
    return load_pairs(spark, T.comparison_csv(spark, sf_dir), 25).select("source_row_index", "pair_id")


def cue_expand(spark, sf_dir):
    return P.expand_cues(T.conversation_pairs(spark, sf_dir), "authority").select("pair_id", "human_winner", "variant_id", "cue_congruency", "cue_target", "cue_text")


def seed_expand(spark, sf_dir):
    return requests(T.conversation_pairs(spark, sf_dir).select("pair_id"), 4, 0.6).select("pair_id", "kind", "seed", "temperature")


def _replayed(spark, sf_dir):
    examples = expand_swaps(T.conversation_pairs(spark, sf_dir)).withColumn("prompt_text", P.chat_prompt("position", F.col("prompt_messages"), F.col("answer_a"), F.col("answer_b")))
    asked = requests(examples, 3)
    return examples, replayed(asked.select(*E.KEYS, "kind", "seed", "temperature", "prompt_text"), T.answers(asked), E.KEYS)


def replay_join(spark, sf_dir):
    return rounded(_replayed(spark, sf_dir)[1].select("source_row_index", "variant_id", "kind", "seed", "verdict", "p_a", "p_b", "p_tie"))


def run_records(spark, sf_dir):
    examples, judgments = _replayed(spark, sf_dir)
    examples = examples.withColumns({"cue_target": F.lit(None).cast("string"), "cue_congruency": F.lit("none"), "cue_text": F.lit(None).cast("string"), "prompt_hash": P.chat_hash("position", F.col("example_id"), F.col("prompt_text"))})
    greedy = E.with_metrics(judgments.filter("kind = 'greedy'")).drop("kind", "seed", "temperature", "raw_text")
    votes = judgments.filter("kind = 'sampled'").select(*E.KEYS, "verdict").join(greedy.select(*E.KEYS, F.col("verdict").alias("anchor")), E.KEYS)
    spec = {"dataset_name": "conversations", "dataset_split": "position_stratified", "model_name": "replay-judge", "backend_name": "replay", "consistency_runs": 3, "temperature": 0.7}
    found = E.run_records(examples, greedy.join(consistency(votes, E.KEYS), E.KEYS), spec, "position")
    u = "uncertainty"
    return rounded(found.select(
        "record_id", "example_id", "question_id", "verdict", "raw_output", "prompt_hash", F.col("metadata.underlying_response_id").alias("underlying_response_id"), F.md5(F.col("metadata.prompt_preview").cast("binary")).alias("preview_md5"),
        F.col(f"{u}.logit.entropy").alias("entropy"), F.col(f"{u}.logit.margin").alias("margin"), F.col(f"{u}.consistency.agreement_rate").alias("agreement_rate"), F.col(f"{u}.consistency.flip_rate").alias("flip_rate"),
        F.col(f"{u}.consistency.vote_entropy").alias("vote_entropy"), F.col("spec.dataset_split").alias("dataset_split"),
    ))


def label_probabilities(spark, sf_dir):
    score, k = lambda i: F.get("embedding", F.lit(i)).cast("double"), F.col("vec_id")
    token = lambda text, logprob, when: F.when(when, F.struct(F.lit(text).alias("token"), logprob.alias("logprob")))
    tokens = F.array_compact(F.array(token(" A", score(0), k % 5 > 0), token("a\n", score(1), k % 5 > 0), token("B", score(2), k % 3 > 0), token("t", score(3), k % 2 > 0), token("Apple", score(4), F.lit(True))))
    return rounded(T.table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(f"p_{n.lower()}") for n, c in U.label_probabilities(tokens).items()]))


def metrics_of_map(spark, sf_dir):
    k = F.col("event_id") % 4
    probs = F.map_from_entries(F.slice(F.array(*[F.struct(F.lit(n).alias("k"), F.lit(p).alias("v")) for n, p in (("A", 0.5), ("B", 0.25), ("tie", 0.0))]), F.lit(1), k.cast("int")))
    return rounded(T.table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in U.logit_metrics_of_map(probs).items()]))


def conversation_cells(spark, sf_dir):
    cells = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(X.CELLS)], "k int, cell string")
    one = F.transform(C.conversation(F.col("cell")), lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return cells.select("k", F.array_join(one, "|").alias("messages"))


def example_check(spark, sf_dir):
    own = F.filter("messages", lambda m: m["role"] == "assistant")
    entries = F.transform(own, lambda m, i: F.struct(F.when(i == 0, "A").when(i == 1, "B").when(i == 2, "C").otherwise("D").alias("label"), m["content"].alias("response")))
    rows = T.messages(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("example_id"), F.map_from_entries(F.transform(F.slice(entries, 1, 4), lambda x: F.struct(x["label"].alias("k"), x.alias("v")))).alias("candidates"),
        F.element_at(F.array(F.lit("A"), F.lit("both"), F.lit(None)), (F.col("conv_id") % 3 + 1).cast("int")).alias("human_winner"),
    )
    return rows.select("example_id", fault(rows).alias("fault"))


def jsonl_lines(spark, sf_dir):
    path = T.scratch(spark, "jsonl")
    sinks.write_jsonl(T.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", "text").alias("message"), F.lit(None).cast("string").alias("note")), path)
    lines = spark.read.text(path)
    return lines.select(F.md5(F.col("value").cast("binary")).alias("line_md5"), F.length("value").alias("n_chars"))


def csv_sink(spark, sf_dir):
    """The sampled rows of a label each, written as CSV and read back."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    path = T.scratch(spark, "csv")
    sinks.write_csv(S.shuffled(S.stratified_sample(docs, "lang", "doc_id", 60, strict=False), "doc_id").select("doc_id", "lang", "source"), path)
    return spark.read.option("header", True).csv(path)


def stratified_sample(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return S.stratified_sample(docs, "lang", "doc_id", 60, strict=False).select("doc_id", "lang", "stratum_rank")


def label_counts(spark, sf_dir):
    return S.value_counts(T.table(spark, sf_dir, "documents").select("lang"), "lang")


def distinct_models(spark, sf_dir):
    return S.distinct_over(T.table(spark, sf_dir, "documents"), "lang", "source")


def label_census(spark, sf_dir):
    return S.labels_of(T.table(spark, sf_dir, "documents"), "lang")


def json_message_parse(spark, sf_dir):
    cells = T.messages(spark, sf_dir).select("conv_id", F.to_json("messages").alias("cell"))
    kept = C.conversation(F.col("cell"))
    return cells.select("conv_id", F.size(kept).alias("n_messages"), F.md5(C.rendered(C.prompt_messages(F.col("cell"))).cast("binary")).alias("rendered_md5"))


def underlying_response(spark, sf_dir):
    rows = T.judged(spark, sf_dir, ["original"])
    pick = F.when(F.col("verdict") == "A", F.concat(F.col("pair_id").cast("string"), F.lit(":response_a"))).when(F.col("verdict") == "B", F.concat(F.col("pair_id").cast("string"), F.lit(":response_b")))
    return rows.select("pair_id", "verdict", pick.alias("underlying_response_id"))


FLAGSHIP: Query = position_pair_summary
_ALL = (
    softmax_probs, logit_metrics, verbalized_metrics, verdict_argmax, verdict_parse, consistency_votes, consistency_runs, position_pair_summary, position_summary, authority_pair_summary,
    authority_summary, bandwagon_summary, item_aggregate, winner_normalize, pair_swap_expand, condition_matrix, conversation_final_response, shared_prefix, first_user_question, position_prompt,
    authority_prompt, matrix_prompt, prompt_hash, matrix_hash, stratified_sample, label_counts, distinct_models, label_census, json_message_parse, underlying_response, csv_pairs, csv_conversations, csv_limit,
    cue_expand, seed_expand, replay_join, run_records, label_probabilities, metrics_of_map, conversation_cells, example_check, jsonl_lines, csv_sink,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _ALL}


# --- SQL ---------------------------------------------------------------------------------------------------------------

_SCORED = "SELECT vec_id AS pair_id, CASE label % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS human_winner, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"


def _argmax(a: str, b: str, t: str) -> str:
    return f"CASE WHEN {a} >= {b} AND {a} >= {t} THEN 'A' WHEN {b} >= {t} THEN 'B' ELSE 'tie' END"


def _slot_sql(k: int) -> str:
    """Probabilities, verdict and metrics of one slot of a scored row."""
    a, b, t = (f"e[{3 * k + j}]" for j in (1, 2, 3))
    m = f"greatest({a}, {b}, {t})"
    x = [f"exp(({v} - {m}) / {T.TEMPERATURE})" for v in (a, b, t)]
    return f"""SELECT pair_id, human_winner, e, p_a, p_b, p_tie, {_argmax('p_a', 'p_b', 'p_tie')} AS verdict, greatest(p_a, p_b, p_tie) AS msp,
  list_sort([p_a, p_b, p_tie], 'DESC')[1] - list_sort([p_a, p_b, p_tie], 'DESC')[2] AS margin,
  -(CASE WHEN p_a > 0 THEN p_a * log2(p_a) ELSE 0 END + CASE WHEN p_b > 0 THEN p_b * log2(p_b) ELSE 0 END + CASE WHEN p_tie > 0 THEN p_tie * log2(p_tie) ELSE 0 END) AS entropy
  FROM (SELECT pair_id, human_winner, e, x / (x + y + z) AS p_a, y / (x + y + z) AS p_b, z / (x + y + z) AS p_tie FROM (SELECT *, {x[0]} AS x, {x[1]} AS y, {x[2]} AS z FROM ({_SCORED})))"""


_RUNS = [_argmax(*(f"e[{9 + 3 * k + j}]" for j in (1, 2, 3))) for k in range(T.RUNS)]
_AGREE = "greatest(" + ", ".join("(" + " + ".join(f"CASE WHEN ({r}) = '{x}' THEN 1 ELSE 0 END" for r in _RUNS) + ")" for x in ("A", "B", "tie")) + f") / {float(T.RUNS)}"

_POSITION = f"""SELECT CAST(o.pair_id AS BIGINT) AS pair_id, o.verdict AS original_verdict, s.verdict AS swapped_verdict,
  CASE o.verdict WHEN 'A' THEN o.pair_id || ':response_a' WHEN 'B' THEN o.pair_id || ':response_b' END AS original_response_id,
  CASE s.verdict WHEN 'A' THEN o.pair_id || ':response_b' WHEN 'B' THEN o.pair_id || ':response_a' END AS swapped_response_id,
  o.verdict <> 'tie' AND s.verdict <> 'tie' AND o.verdict = s.verdict AS position_flip, o.entropy AS original_entropy, o.msp AS original_msp, o.margin AS original_margin,
  o.agree AS original_agreement_rate, s.entropy AS swapped_entropy, o.agree AS swapped_agreement_rate
  FROM (SELECT *, {_AGREE} AS agree FROM ({_slot_sql(0)})) o JOIN ({_slot_sql(1)}) s ON o.pair_id = s.pair_id"""


def _cue_sql(f: str) -> str:
    parts = []
    for name, target, alias in (("congruent", "c.human_winner", "g"), ("incongruent", "CASE c.human_winner WHEN 'A' THEN 'B' ELSE 'A' END", "i")):
        v = f"{f}_{name}"
        parts.append(
            f"{alias}.verdict AS {v}_verdict, {alias}.entropy AS {v}_entropy, {alias}.entropy - c.entropy AS {v}_delta_entropy, c.agree AS {v}_agreement_rate, {target} AS {v}_cue_target, "
            f"{alias}.verdict = {target} AS {v}_cue_follow, {alias}.verdict <> c.verdict AS {v}_shift_from_control"
        )
    return f"""SELECT c.pair_id, c.human_winner, c.verdict AS control_verdict, c.entropy AS control_entropy, c.agree AS control_agreement_rate, {', '.join(parts)}
  FROM (SELECT *, {_AGREE} AS agree FROM ({_slot_sql(0)})) c JOIN ({_slot_sql(1)}) g ON c.pair_id = g.pair_id JOIN ({_slot_sql(2)}) i ON c.pair_id = i.pair_id WHERE c.human_winner <> 'tie'"""


def _cue_summary_sql(f: str) -> str:
    sides = (f"{f}_congruent", f"{f}_incongruent")
    rate = lambda c, n: f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS {n}"
    columns = ["count(*) AS total_pairs_evaluated", "round(avg(control_entropy), 6) AS mean_control_entropy"]
    for v in sides:
        columns += [f"round(avg({v}_entropy), 6) AS mean_{v}_entropy", f"round(avg({v}_delta_entropy), 6) AS mean_{v}_delta_entropy", rate(f"{v}_cue_follow", f"{v}_cue_follow_rate"), rate(f"{v}_shift_from_control", f"{v}_shift_rate")]
    return f"SELECT {', '.join(columns)} FROM ({_cue_sql(f)})"


_CONSISTENCY = """SELECT {key}, CAST(sum(n) AS BIGINT) AS run_count, round(max(n) / sum(n), 6) AS agreement_rate,
  round(-sum(n / t * log2(n / t)), 6) AS vote_entropy, count(*) AS unique_verdict_count, round(sum(flips) / sum(n), 6) AS flip_rate
  FROM (SELECT *, sum(n) OVER (PARTITION BY {key}) AS t FROM (SELECT {key}, verdict, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE verdict <> anchor) AS DOUBLE) AS flips FROM ({votes}) GROUP BY {key}, verdict))
  GROUP BY {key}"""
_MESSAGES = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id"
_OWN = "list_filter(messages, lambda m: m.role = 'assistant')"
_PAIRS = f"""SELECT conv_id, CAST(conv_id AS VARCHAR) AS pair_id, messages, messages[1 : list_position(list_transform(messages, lambda m: m.role), 'assistant') - 1] AS prompt,
  {_OWN}[1].content AS response_a, {_OWN}[2].content AS response_b, CASE conv_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS human_winner
  FROM ({_MESSAGES}) WHERE len({_OWN}) >= 2"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x1c-\x1f\x{{85}}\pZ]+|[\s\x1c-\x1f\x{{85}}\pZ]+$', '', 'g')"


def _rendered(messages: str) -> str:
    return f"coalesce(array_to_string(list_transform({messages}, lambda m: upper(m.role) || ':\n' || {_strip('m.content')}), '\n\n'), '')"


def _chat_sql(family: str) -> str:
    cue = "CASE WHEN human_winner <> 'tie' THEN 'Authority cue: A senior expert evaluator previously judged Answer ' || human_winner || ' to be the stronger response.\n\n' ELSE '' END" if family == "authority" else "''"
    head, tail = _text(f"<|im_start|>system\n{X.SYSTEM[family]}<|im_end|>\n<|im_start|>user\n"), _text(f"\n\n{X.LABEL_LINE}<|im_end|>\n<|im_start|>assistant\n")
    return f"""SELECT conv_id, pair_id, human_winner, {head} || {cue} || 'Conversation:\n' || {_rendered('prompt')} || '\n\nAnswer A:\n' || {_strip('response_a')} || '\n\nAnswer B:\n' || {_strip('response_b')} || {tail} AS prompt_text FROM ({_PAIRS})"""


_QUESTION = "coalesce(list_filter(messages, lambda m: m.role = 'user' AND m.content <> '')[1].content, messages[1].content, '')"


def _conditions_sql() -> str:
    return "VALUES " + ", ".join(f"({k}, {_text(v)}, {_text(b)}, {_text(i)})" for k, v, b, i in X.CONDITIONS)


def _matrix_parts_sql() -> str:
    first, second = ("CASE WHEN variant_id = 'position_swapped' THEN response_b ELSE response_a END", "CASE WHEN variant_id = 'position_swapped' THEN response_a ELSE response_b END")
    question = _QUESTION.replace("messages", "prompt")
    user = f"'[Question]\n' || {_strip(question)} || '\n\n[Response A]\n' || {_strip(first)} || '\n\n[Response B]\n' || {_strip(second)} || '\n' || injection || '\nWhich response better addresses the question?'"
    return f"SELECT pair_id, variant_id, bias_type, {_text(X.MATRIX)} AS s, {user} AS u FROM ({_PAIRS}) CROSS JOIN ({_conditions_sql()}) AS v(k, variant_id, bias_type, injection)"


def _matrix_sql() -> str:
    t = "s || '\n\n' || u"
    return f"SELECT pair_id AS example_id, variant_id, bias_type, CAST(length({t}) AS INTEGER) AS n_chars, md5({t}) AS prompt_md5 FROM ({_matrix_parts_sql()})"


def _matrix_hash_sql() -> str:
    j, middle = X.json_string, " || ', \"output_mode\": \"choice_only\", \"system\": ' || "
    tail = f"{j('s')} || ', \"user\": ' || {j('u')} || ', \"variant_id\": ' || {j('variant_id')} || '}}'"
    plain = f"'{{\"allowed_labels\": [\"A\", \"B\", \"tie\"], \"bias_type\": ' || {j('bias_type')}" + middle + tail
    pinned = f"'{{\"allowed_labels\": [\"A\", \"B\"], \"bias_type\": ' || {j('bias_type')} || ', \"extra_metadata\": {{\"round\": 3, \"template\": \"v2\"}}'" + middle + tail
    return f"SELECT pair_id AS example_id, variant_id, {X.digest(plain)} AS prompt_hash, {X.digest(pinned)} AS pinned_hash FROM ({_matrix_parts_sql()})"


_CUE = "CASE WHEN human_winner <> 'tie' THEN '\"Authority cue: A senior expert evaluator previously judged Answer ' || human_winner || ' to be the stronger response.\"' ELSE 'null' END"


def _chat_hash_sql() -> str:
    position = f"'{{\"example_id\": ' || {X.json_string('p.pair_id')} || ', \"output_mode\": \"choice_only\", \"prompt_text\": ' || {X.json_string('p.prompt_text')} || '}}'"
    authority = f"'{{\"cue_text\": ' || {_CUE.replace('human_winner', 'a.human_winner')} || ', \"example_id\": ' || {X.json_string('a.pair_id')} || ', \"output_mode\": \"choice_only\", \"prompt_text\": ' || {X.json_string('a.prompt_text')} || '}}'"
    return f"SELECT p.pair_id, {X.digest(position)} AS position_hash, {X.digest(authority)} AS authority_hash FROM ({_chat_sql('position')}) p JOIN ({_chat_sql('authority')}) a ON p.pair_id = a.pair_id"


def _csv_sql() -> str:
    """Pairs by their places in the file; conv_id % 5 = 0 has no id, % 4 = 3 no winner, % 11 = 0 a blank response."""
    own = "CASE WHEN conv_id % 5 = 0 THEN 'row-' || i ELSE 'c' || conv_id END || CASE WHEN conv_id % 3 > 0 THEN ':turn-' || (conv_id % 3) ELSE '' END"
    return f"""SELECT i AS source_row_index, {own} AS pair_id, CASE WHEN conv_id % 3 > 0 THEN CAST(conv_id % 3 AS VARCHAR) END AS turn, ['A', 'B', 'tie'][CAST(conv_id % 4 + 1 AS INTEGER)] AS human_winner,
  CASE WHEN conv_id % 2 = 0 THEN 'm' END AS model_a, CAST(NULL AS VARCHAR) AS model_b, md5(CASE WHEN len(prompt) = 0 THEN 'USER:\n[]' ELSE {_rendered('prompt')} END) AS prompt_md5, md5('"so", ' || response_a || '\nend\\') AS a_md5, md5({_strip('response_b')}) AS b_md5
  FROM (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS i FROM ({_PAIRS})) WHERE conv_id % 4 < 3 AND conv_id % 11 > 0"""


def _csv_conversations_sql() -> str:
    prefix = "CASE WHEN conv_id % 2 = 0 OR len(messages) = 1 THEN CASE WHEN len(messages) > 1 THEN messages[1 : len(messages) - 1] ELSE messages END ELSE messages[1 : len(messages) - 1] END"
    last = _strip(f"coalesce(({_OWN})[-1].content, messages[-1].content)")
    return f"SELECT CAST(conv_id AS VARCHAR) AS pair_id, CAST(len(p) AS INTEGER) AS n_prompt, md5({_rendered('p')}) AS prompt_md5, md5(a) AS a_md5, 'other ' || conv_id AS response_b FROM (SELECT *, {prefix} AS p, {last} AS a FROM ({_MESSAGES})) WHERE a <> ''"


_VARIANTS = f"""SELECT conv_id, pair_id, 'original' AS variant_id, 0 AS v, 'a' AS one, 'b' AS two, prompt, response_a AS a, response_b AS b FROM ({_PAIRS})
  UNION ALL SELECT conv_id, pair_id, 'swapped', 1, 'b', 'a', prompt, response_b, response_a FROM ({_PAIRS})"""
_WEIGHTS = "CAST(conv_id % 7 + 1 AS DOUBLE) AS wa, CAST(conv_id % 5 + 1 AS DOUBLE) AS wb, CASE WHEN conv_id % 4 > 1 THEN CAST(conv_id % 3 + 1 AS DOUBLE) ELSE 0.0 END AS wt"


def _replay_sql() -> str:
    verdict = "['A', 'B', 'tie'][CAST((conv_id + v + CASE kind WHEN 'sampled' THEN seed * seed ELSE 0 END) % 3 + 1 AS INTEGER)]"
    one = lambda w, label: f"CASE WHEN conv_id % 4 = 0 THEN CASE WHEN verdict = '{label}' THEN 1.0 ELSE 0.0 END ELSE {w} / (wa + wb + wt) END"
    return f"""SELECT *, {one('wa', 'A')} AS p_a, {one('wb', 'B')} AS p_b, {one('wt', 'tie')} AS p_tie FROM (SELECT *, {verdict} AS verdict, {_WEIGHTS} FROM ({_VARIANTS})
  CROSS JOIN (VALUES ('greedy', 0), ('sampled', 0), ('sampled', 1), ('sampled', 2)) AS k(kind, seed))"""


def _run_records_sql() -> str:
    text = f"""{_text("<|im_start|>system" + chr(10) + X.SYSTEM["position"] + "<|im_end|>" + chr(10) + "<|im_start|>user" + chr(10) + "Conversation:" + chr(10))} || {_rendered('prompt')} || '\n\nAnswer A:\n' || {_strip('a')} || '\n\nAnswer B:\n' || {_strip('b')} || {_text(chr(10) * 2 + X.LABEL_LINE + "<|im_end|>" + chr(10) + "<|im_start|>assistant" + chr(10))}"""
    entropy = " ".join(f"- CASE WHEN {p} > 0 THEN {p} * log2({p}) ELSE 0 END" for p in ("p_a", "p_b", "p_tie"))
    votes = f"""SELECT conv_id, variant_id, max(n) / 3.0 AS agreement_rate, -sum(n / 3.0 * log2(n / 3.0)) AS vote_entropy, max_by(verdict, 0) AS any_verdict FROM (SELECT conv_id, variant_id, verdict, count(*) AS n FROM ({_replay_sql()}) WHERE kind = 'sampled' GROUP BY ALL) GROUP BY ALL"""
    flips = f"SELECT s.conv_id, s.variant_id, avg(CASE WHEN s.verdict <> g.verdict THEN 1.0 ELSE 0.0 END) AS flip_rate FROM ({_replay_sql()}) s JOIN ({_replay_sql()}) g ON s.conv_id = g.conv_id AND s.variant_id = g.variant_id WHERE s.kind = 'sampled' AND g.kind = 'greedy' GROUP BY ALL"
    prompt_json = f"'{{\"example_id\": ' || {X.json_string('example_id')} || ', \"output_mode\": \"choice_only\", \"prompt_text\": ' || {X.json_string('t')} || '}}'"
    record_json = "'{\"example_id\": \"' || example_id || '\", \"model_name\": \"replay-judge\", \"prompt_hash\": \"' || prompt_hash || '\", \"seed\": 0, \"variant_id\": \"' || variant_id || '\"}'"
    return f"""SELECT {X.digest(record_json)} AS record_id, example_id, pair_id AS question_id, verdict, verdict AS raw_output, prompt_hash,
  CASE verdict WHEN 'A' THEN pair_id || ':response_' || one WHEN 'B' THEN pair_id || ':response_' || two END AS underlying_response_id, md5(substr(t, 1, 200)) AS preview_md5,
  round(0.0 {entropy}, 6) AS entropy, round(list_sort([p_a, p_b, p_tie], 'DESC')[1] - list_sort([p_a, p_b, p_tie], 'DESC')[2], 6) AS margin,
  round(agreement_rate, 6) AS agreement_rate, round(flip_rate, 6) AS flip_rate, round(vote_entropy, 6) AS vote_entropy, 'position_stratified' AS dataset_split
  FROM (SELECT *, {X.digest(prompt_json)} AS prompt_hash FROM (SELECT *, pair_id || ':' || variant_id AS example_id, {text} AS t FROM ({_replay_sql()}) WHERE kind = 'greedy'))
  JOIN ({votes}) USING (conv_id, variant_id) JOIN ({flips}) USING (conv_id, variant_id)"""


_TOKENS = """SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN greatest(CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)) END AS a, CASE WHEN vec_id % 3 > 0 THEN CAST(embedding[3] AS DOUBLE) END AS b, CASE WHEN vec_id % 2 > 0 THEN CAST(embedding[4] AS DOUBLE) END AS t FROM embeddings"""


def _label_probabilities_sql() -> str:
    share = lambda c: f"CASE WHEN coalesce(a, b, t) IS NOT NULL THEN round(coalesce(exp({c}), 0.0) / (coalesce(exp(a), 0.0) + coalesce(exp(b), 0.0) + coalesce(exp(t), 0.0)), 6) END"
    return f"SELECT vec_id, {share('a')} AS p_a, {share('b')} AS p_b, {share('t')} AS p_tie FROM ({_TOKENS})"


def _jsonl_sql() -> str:
    line = f"""'{{"conv_id":' || conv_id || ',"turn":' || turn || ',"message":{{"role":' || {X.json_string('role', '04X')} || ',"text":' || {X.json_string('text', '04X')} || '}},"note":null}}'"""
    return f"SELECT md5(line) AS line_md5, CAST(length(line) AS INTEGER) AS n_chars FROM (SELECT {line} AS line FROM conversations)"


def _swap_sql() -> str:
    one = "SELECT pair_id, '{v}' AS variant_id, pair_id || ':{v}' AS example_id, md5({a}) AS a_md5, md5({b}) AS b_md5, pair_id || ':{a}' AS response_id_a, pair_id || ':{b}' AS response_id_b, {w} AS side_winner FROM ({p})"
    swapped = "CASE human_winner WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE human_winner END"
    return " UNION ALL ".join(one.format(v=v, a=a, b=b, w=w, p=_PAIRS) for v, a, b, w in (("original", "response_a", "response_b", "human_winner"), ("swapped", "response_b", "response_a", swapped)))


def _rounded_sql(sql: str, exact: list[str], doubles: list[str]) -> str:
    return f"SELECT {', '.join(exact + [f'round({c}, 6) AS {c}' for c in doubles])} FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    spelled = "[' Model_A ', '2', 'right', 'EQUAL', 'tie (inconsistent)', '', 'left', 'response_b'][event_id % 8 + 1]"
    known = f"WHEN lower(trim({spelled})) IN ('a', 'model_a', 'response_a', '1', 'left') THEN 'A' WHEN lower(trim({spelled})) IN ('b', 'model_b', 'response_b', '2', 'right') THEN 'B' WHEN lower(trim({spelled})) IN ('tie', 'equal') THEN 'tie'"
    runs = f"SELECT pair_id, {_argmax('e[1]', 'e[2]', 'e[3]')} AS anchor, unnest([{', '.join(_RUNS)}]) AS verdict FROM ({_SCORED})"
    votes = "SELECT user_id, event_type AS verdict, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS anchor FROM events"
    cue_exact = ["pair_id", "human_winner", "control_verdict", *[f"authority_{s}_{c}" for s in ("congruent", "incongruent") for c in ("verdict", "cue_target", "cue_follow", "shift_from_control")]]
    cue_doubles = ["control_entropy", "control_agreement_rate", *[f"authority_{s}_{c}" for s in ("congruent", "incongruent") for c in ("entropy", "delta_entropy", "agreement_rate")]]
    position_exact = ["pair_id", "original_verdict", "swapped_verdict", "original_response_id", "swapped_response_id", "position_flip"]
    position_doubles = ["original_entropy", "original_msp", "original_margin", "original_agreement_rate", "swapped_entropy", "swapped_agreement_rate"]
    items = " UNION ALL ".join(f"SELECT pair_id, verdict, entropy, msp FROM ({_slot_sql(k)})" for k in range(3))
    usable = "count(*) FILTER (WHERE original_verdict <> 'tie' AND swapped_verdict <> 'tie')"
    bare = _strip("coalesce(text, '')")
    return {
        "softmax_probs": f"SELECT pair_id, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, round(p_tie, 6) AS p_tie FROM ({_slot_sql(0)})",
        "logit_metrics": f"SELECT pair_id, round(entropy, 6) AS entropy, round(msp, 6) AS msp, round(margin, 6) AS margin, round(entropy / log2(3), 6) AS normalized_entropy FROM ({_slot_sql(0)})",
        "verbalized_metrics": "SELECT event_id, round(least(greatest(value, 0), 100) / 100, 6) AS confidence, round(1 - least(greatest(value, 0), 100) / 100, 6) AS uncertainty FROM events",
        "verdict_argmax": f"SELECT pair_id, verdict FROM ({_slot_sql(0)})",
        "verdict_parse": f"SELECT doc_id, CASE upper(substr({bare}, 1, 1)) WHEN 'A' THEN 'A' WHEN 'B' THEN 'B' WHEN 'T' THEN 'tie' END AS verdict FROM documents",
        "consistency_votes": _CONSISTENCY.format(key="user_id", votes=votes),
        "consistency_runs": _CONSISTENCY.format(key="pair_id", votes=runs),
        "position_pair_summary": _rounded_sql(_POSITION, position_exact, position_doubles),
        "position_summary": f"SELECT count(*) AS total_pairs_loaded, {usable} AS usable_pairs_for_flip, count(*) FILTER (WHERE position_flip) AS flip_count, round(count(*) FILTER (WHERE position_flip) / nullif({usable}, 0), 6) AS flip_rate FROM ({_POSITION})",
        "authority_pair_summary": _rounded_sql(_cue_sql("authority"), cue_exact, cue_doubles),
        "authority_summary": _cue_summary_sql("authority"),
        "bandwagon_summary": _cue_summary_sql("bandwagon"),
        "item_aggregate": f"""SELECT CAST(pair_id AS VARCHAR) AS example_id, CAST(pair_id AS VARCHAR) AS question_id, 'position' AS bias_name, 'replay' AS model_name, CAST(sum(n) AS BIGINT) AS run_count,
  list(verdict ORDER BY n DESC, verdict)[1] AS dominant_verdict, round(sum(s) / sum(n), 6) AS mean_entropy, round(sum(m) / sum(n), 6) AS mean_msp, CAST(NULL AS DOUBLE) AS mean_verbalized_uncertainty, round(max(n) / sum(n), 6) AS agreement_rate
  FROM (SELECT pair_id, verdict, count(*) AS n, sum(entropy) AS s, sum(msp) AS m FROM ({items}) GROUP BY pair_id, verdict) GROUP BY pair_id""",
        "winner_normalize": f"SELECT event_id, CASE {known} END AS winner FROM events",
        "pair_swap_expand": _swap_sql(),
        "condition_matrix": f"SELECT * FROM ({_conditions_sql()}) AS v(k, variant_id, bias_type, injection)",
        "conversation_final_response": f"SELECT conv_id, md5({_strip(f"coalesce(({_OWN})[-1].content, messages[-1].content, '')")}) AS response_md5 FROM ({_MESSAGES})",
        "shared_prefix": f"SELECT conv_id, CAST(least(len(messages), 2) AS INTEGER) AS n_shared, CAST(least(len(messages), 2) AS INTEGER) AS n_prompt FROM ({_MESSAGES})",
        "first_user_question": f"SELECT conv_id, md5({_QUESTION}) AS question_md5 FROM ({_MESSAGES})",
        "position_prompt": f"SELECT pair_id, CAST(length(prompt_text) AS INTEGER) AS n_chars, md5(prompt_text) AS prompt_md5 FROM ({_chat_sql('position')})",
        "authority_prompt": f"SELECT pair_id, CAST(length(prompt_text) AS INTEGER) AS n_chars, md5(prompt_text) AS prompt_md5 FROM ({_chat_sql('authority')})",
        "matrix_prompt": _matrix_sql(),
        "prompt_hash": _chat_hash_sql(),
        "matrix_hash": _matrix_hash_sql(),
        "csv_pairs": _csv_sql(),
        "csv_conversations": _csv_conversations_sql(),
        "csv_limit": f"SELECT source_row_index, pair_id FROM ({_csv_sql()}) ORDER BY source_row_index LIMIT 25",
        "cue_expand": f"""SELECT pair_id, human_winner, variant_id, congruency AS cue_congruency, target AS cue_target, 'Authority cue: A senior expert evaluator previously judged Answer ' || target || ' to be the stronger response.' AS cue_text
  FROM (SELECT pair_id, human_winner, variant_id, congruency, CASE congruency WHEN 'congruent' THEN human_winner WHEN 'incongruent' THEN CASE human_winner WHEN 'A' THEN 'B' ELSE 'A' END END AS target
    FROM ({_PAIRS}) CROSS JOIN (VALUES ('control', 'control'), ('authority_congruent', 'congruent'), ('authority_incongruent', 'incongruent')) AS v(variant_id, congruency) WHERE human_winner <> 'tie')""",
        "seed_expand": f"SELECT pair_id, kind, seed, CASE kind WHEN 'greedy' THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS temperature FROM ({_PAIRS}) CROSS JOIN (VALUES ('greedy', 0), ('sampled', 0), ('sampled', 1), ('sampled', 2), ('sampled', 3)) AS k(kind, seed)",
        "replay_join": f"SELECT conv_id AS source_row_index, variant_id, kind, seed, verdict, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, round(p_tie, 6) AS p_tie FROM ({_replay_sql()})",
        "run_records": _run_records_sql(),
        "label_probabilities": _label_probabilities_sql(),
        "metrics_of_map": """SELECT event_id, [NULL, 0.5, 1.0, 1.0][CAST(event_id % 4 + 1 AS INTEGER)]::DOUBLE AS entropy, [NULL, 0.5, 0.5, 0.5][CAST(event_id % 4 + 1 AS INTEGER)]::DOUBLE AS msp,
  [NULL, 0.0, 0.25, 0.25][CAST(event_id % 4 + 1 AS INTEGER)]::DOUBLE AS margin, [NULL, 0.0, 1.0, 0.63093][CAST(event_id % 4 + 1 AS INTEGER)]::DOUBLE AS normalized_entropy FROM events""",
        "conversation_cells": "SELECT * FROM (VALUES " + ", ".join(f"({k}, {_text(m)})" for k, (_, m) in enumerate(X.CELLS)) + ") AS v(k, messages)",
        "example_check": f"""SELECT CAST(conv_id AS VARCHAR) AS example_id, CASE WHEN len({_OWN}) = 0 THEN 'candidates must not be empty' WHEN len({_OWN}) > 3 THEN 'candidates: unknown label' WHEN conv_id % 3 = 1 THEN 'human_winner: unknown value both' END AS fault FROM ({_MESSAGES})""",
        "jsonl_lines": _jsonl_sql(),
        "csv_sink": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || '|42'), doc_id) AS r FROM documents WHERE lang IS NOT NULL) WHERE r <= floor(60 / (SELECT count(DISTINCT lang) FROM documents))",
        "stratified_sample": "SELECT doc_id, lang, CAST(r AS INTEGER) AS stratum_rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || '|42'), doc_id) AS r FROM documents WHERE lang IS NOT NULL) WHERE r <= floor(60 / (SELECT count(DISTINCT lang) FROM documents))",
        "label_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
        "distinct_models": "SELECT count(DISTINCT v) AS n_distinct FROM (SELECT lang AS v FROM documents UNION ALL SELECT source FROM documents)",
        "label_census": "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL",
        "json_message_parse": f"SELECT conv_id, CAST(len(messages) AS INTEGER) AS n_messages, md5({_rendered('messages')}) AS rendered_md5 FROM ({_MESSAGES})",
        "underlying_response": f"SELECT pair_id, verdict, CASE verdict WHEN 'A' THEN pair_id || ':response_a' WHEN 'B' THEN pair_id || ':response_b' END AS underlying_response_id FROM ({_slot_sql(0)})",
    }
