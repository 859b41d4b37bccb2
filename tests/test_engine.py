import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from judgeloom.functions import conversation as C
from judgeloom.functions import labels as L
from judgeloom.functions import uncertainty as U
from judgeloom.functions.text import digest_column, payload_digest, strip
from judgeloom.operators import prompts as P
from judgeloom.operators.consistency import consistency
from judgeloom.operators.sampling import stratified_sample
from judgeloom.plans.experiments import run_experiment
from judgeloom.sources.pairs import expand_swaps, load_pairs, resolve_columns


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("probs, want", [
    ((0.18, 0.77, 0.05), (0.9517476484356663, 0.77, 0.59, 0.6004859092897291)), ((0.2, 0.7, 0.1), (1.1567796494470395, 0.7, 0.5, 0.7298466991620975)), ((1.0, 0.0, 0.0), (0.0, 1.0, 1.0, 0.0)),
])
def test_logit_metrics(spark, probs, want):
    row = one(spark, **U.logit_metrics(*[F.lit(p) for p in probs]))
    assert [pytest.approx(w, abs=1e-12) for w in want] == list(row)
    of_map = one(spark, **U.logit_metrics_of_map(F.create_map(F.lit("A"), F.lit(probs[0]), F.lit("B"), F.lit(probs[1]), F.lit("tie"), F.lit(probs[2]))))
    assert [pytest.approx(w, abs=1e-12) for w in want] == list(of_map)


def test_metrics_of_odd_maps(spark):
    row = one(spark, **U.logit_metrics_of_map(F.create_map().cast("map<string,double>")))
    assert list(row) == [None] * 4
    assert one(spark, **U.logit_metrics_of_map(F.create_map(F.lit("A"), F.lit(1.0))))["normalized_entropy"] == 0.0


def test_verbalized(spark):
    for given, want in ((None, (None, None)), (72.0, (0.72, 0.28)), (-5.0, (0.0, 1.0)), (490.02, (1.0, 0.0))):
        row = one(spark, **U.verbalized_metrics(F.lit(given).cast("double")))
        assert list(row) == [None if w is None else pytest.approx(w) for w in want]


def test_label_probabilities(spark):
    tokens = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(p).alias("logprob")) for t, p in ((" A", -1.0), ("a", -3.0), ("B", -1.0), ("zz", 0.0))])
    assert list(one(spark, **U.label_probabilities(tokens))) == [0.5, 0.5, 0.0]


def test_consistency(spark):
    votes = spark.createDataFrame([(k, v, "A") for k, vs in ((1, ["A", "A", "B", "A", "tie"]), (2, ["B"] * 5)) for v in vs], "k int, verdict string, anchor string")
    got = {r.k: tuple(r)[1:] for r in consistency(votes, ["k"]).collect()}
    assert got[1] == (5, 0.6, pytest.approx(1.3709505944546687), 3, 0.4)
    assert got[2] == (5, 1.0, pytest.approx(0.0), 1, 1.0)


def test_hashes(spark):
    for payload, want in (({"example_id": "demo-q1", "seed": 0}, "b1db7b304cc9923e"), ({"prompt": "é😀\x7f"}, "6550029b23d206d9")):
        assert payload_digest(payload) == want
    assert one(spark, h=digest_column({"seed": F.lit(0), "example_id": F.lit("q1")})).h == "5de6bf7b4493a18e"
    assert one(spark, s=strip(F.lit("\x1c\u2003 a b\x85\n"))).s == "a b"


def test_winners_and_verdicts(spark):
    for raw, want in ((" Model_A ", "A"), ("2", "B"), ("right", "B"), ("EQUAL", "tie"), ("tie (inconsistent)", None), ("", None)):
        assert one(spark, w=L.normalize_winner(F.lit(raw))).w == want
    none = F.lit(None).cast("double")
    for raw, want in ((" a", "A"), ("Both", "B"), ("The", "tie"), ("?", None)):
        assert one(spark, v=L.parse_verdict(F.lit(raw), none, none, none)).v == want
    assert one(spark, v=L.parse_verdict(F.lit("?"), F.lit(0.5), F.lit(0.5), F.lit(0.0))).v == "A"
    assert one(spark, a=L.swap_label(F.lit("tie")), b=L.opposite_label(F.lit("tie"))).asDict() == {"a": "tie", "b": None}
    with pytest.raises(Exception, match="no verdict"):
        one(spark, v=L.strict_verdict(F.lit("?"), none, none, none))


@pytest.mark.parametrize("cell, want", [
    ("", []), ('[{"role":"user","content":"x"},"str",3,null]', [("user", "x"), ("user", "str")]), ('{"messages":[{"text":"a","speaker":"B"}]}', [("B", "a")]), ('{"messages":"no","turns":[{"content":"t"}]}', [("user", "t")]),
    ('"q"', [("user", '"q"')]), ("[{'content': 'a', 'role': 'user'}]", [("user", "[{'content': 'a', 'role': 'user'}]")]), ('{"k":1}', [("user", '{"k":1}')]),
])
def test_conversation_cells(spark, cell, want):
    assert [tuple(m) for m in one(spark, c=C.conversation(F.lit(cell))).c] == want


@pytest.mark.parametrize("a, b, want", [("abc", "abde", "ab"), ("a", "ab", "a"), ("x", "y", ""), ("", "y", "")])
def test_shared_prefix(spark, a, b, want):
    messages = lambda s: F.array(*[C.message(F.lit("user"), F.lit(c)) for c in s]) if s else C.no_messages()
    assert "".join(m.content for m in one(spark, p=C.shared_prefix(messages(a), messages(b))).p) == want


CSV = (
    "id,pair_id,Response A,response_b,HUMAN-WINNER,question,prompt,turn,model_a\n"
    'q1,zz,"First ""quoted""\nanswer",Second,B,Why?,ignored,1,m\n'
    "\n"
    "q2,zz,,Second,A,Why?,x,,\n"
    "q1,zz,back\\slash,Other,tie,How?,x,1,\n"
    ",zz,One,Two,model_a,What?,x,,\n"
)


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_source(spark, csv):
    rows = load_pairs(spark, csv).orderBy("source_row_index").collect()
    assert [(r.source_row_index, r.pair_id, r.human_winner, r.response_a, r.prompt_messages[0].content, r.model_a) for r in rows] == [
        (0, "q1:turn-1", "B", 'First "quoted"\nanswer', "Why?", "m"), (2, "q1:turn-1", "tie", "back\\slash", "How?", None), (3, "row-3", "A", "One", "What?", None),
    ]
    assert load_pairs(spark, csv, 2).count() == 2
    both = {r.variant_id: r for r in expand_swaps(load_pairs(spark, csv, 1)).collect()}
    assert both["swapped"].answer_a == both["original"].answer_b == "Second" and both["swapped"].side_winner == "A"
    assert (both["original"].response_id_a, both["swapped"].response_id_a) == ("q1:turn-1:response_a", "q1:turn-1:response_b")
    with pytest.raises(KeyError):
        resolve_columns(["prompt", "winner"])
    with pytest.raises(ValueError):
        resolve_columns(["id", "winner", "response_a"])


def test_prompts(spark):
    messages = F.array(C.message(F.lit("user"), F.lit("Why does dropout help?")))
    text = one(spark, p=P.chat_prompt("position", messages, F.lit("First answer"), F.lit("Second answer"))).p
    assert "USER:\nWhy does dropout help?" in text and "Answer A:\nFirst answer" in text and "Answer B:\nSecond answer" in text
    cued = one(spark, p=P.chat_prompt("authority", messages, F.lit("x"), F.lit("y"), P.cue("authority", F.lit("B")))).p
    assert "Authority cue: A senior expert evaluator previously judged Answer B" in cued and "Return exactly one label: A, B, or T." in cued
    control = one(spark, p=P.chat_prompt("authority", messages, F.lit("x"), F.lit("y"), P.cue("authority", F.lit(None).cast("string")))).p
    assert "Authority cue:" not in control
    with pytest.raises(KeyError):
        P.conditions(spark, ["nope"])
    assert [r.bias_type for r in P.conditions(spark, ["anchoring_a"]).collect()] == ["decoy"]


def load_judge():
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = ["Authority cue" in p and "Answer B to" in p for p in pdf["prompt_text"]]
        return pd.DataFrame({"raw_text": ["B" if x else "A" for x in first], "p_a": [0.2 if x else 0.7 for x in first], "p_b": [0.7 if x else 0.2 for x in first], "p_tie": [0.1] * len(pdf)})

    return judge


def test_experiments(spark, csv, tmp_path):
    got = run_experiment(spark, csv, str(tmp_path / "p"), "position", load_judge, consistency_runs=2)
    assert (got["total_pairs_loaded"], got["usable_pairs_for_flip"], got["flip_count"], got["flip_rate"]) == (3, 3, 3, 1.0)
    records = spark.read.json(str(tmp_path / "p" / "run_records")).collect()
    assert len(records) == 6 and all(r.uncertainty.consistency.run_count == 2 and r.metadata.underlying_response_id for r in records)
    got = run_experiment(spark, csv, str(tmp_path / "a"), "authority", load_judge, consistency_runs=1)
    assert got["total_pairs_evaluated"] == 2 and got["authority_congruent_cue_follow_rate"] == 1.0 and got["authority_incongruent_shift_rate"] == 0.5
    lines = [json.loads(x) for p in (tmp_path / "a" / "pair_summary").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and all("authority_congruent_delta_entropy" in x for x in lines)
    with pytest.raises(ValueError):
        run_experiment(spark, csv, str(tmp_path / "n"), "position", load_judge, consistency_runs=0)


def test_answers_in_part(spark):
    from judgeloom.operators.judge import with_verdicts

    rows = spark.createDataFrame([(1, "?", 3.0, 1.0, None), (2, "tie", None, None, None), (3, "?", 0.0, 0.5, 0.5)], "k int, raw_text string, p_a double, p_b double, p_tie double")
    got = {r.k: tuple(r)[2:] for r in with_verdicts(rows).collect()}
    assert got == {1: (0.75, 0.25, 0.0, "A"), 2: (0.0, 0.0, 1.0, "tie"), 3: (0.0, 0.5, 0.5, "B")}
    with pytest.raises(Exception, match="no mass"):
        with_verdicts(spark.createDataFrame([(1, "A", 0.0, 0.0, 0.0)], rows.schema)).collect()


def test_folder_of_csv_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(CSV)
    got = load_pairs(spark, str(tmp_path)).collect()
    assert sorted(r.pair_id for r in got) == ["q1:turn-1"] * 4 + ["row-3"] * 2 and len({r.source_row_index for r in got}) == 6


def test_faults(spark):
    from judgeloom.schemas import checked, fault

    entry = {"A": ("A", "x")}
    rows = spark.createDataFrame([("1", entry, "A"), ("2", {}, "A"), ("3", entry, "x"), (None, entry, None)], "example_id string, candidates map<string, struct<label: string, response: string>>, human_winner string")
    assert {r[0]: r[1] for r in rows.select("example_id", fault(rows)).collect()} == {"1": None, "2": "candidates must not be empty", "3": "human_winner: unknown value x", None: "example_id is missing"}
    assert checked(rows.filter("example_id = '1'")).count() == 1
    with pytest.raises(Exception, match="unknown value x"):
        checked(rows.filter("example_id = '3'")).collect()


def test_public_names():
    import judgeloom

    assert all(getattr(judgeloom, name) is not None for name in judgeloom.__all__) and "record_id" in judgeloom.RUN_RECORD.fieldNames()
    with pytest.raises(AttributeError):
        judgeloom.nothing


def test_written_object(spark, tmp_path):
    from judgeloom.operators.sinks import write_jsonl, write_object, write_summary

    write_object(spark, {"b": "é", "a": None}, str(tmp_path / "deep" / "x.json"))
    assert (tmp_path / "deep" / "x.json").read_text() == '{\n  "b": "\\u00e9",\n  "a": null\n}'
    assert write_summary(spark.sql("SELECT 1 AS n, null AS rate"), str(tmp_path / "s.json")) == json.loads((tmp_path / "s.json").read_text()) == {"n": 1, "rate": None}
    write_jsonl(spark.sql("SELECT 'é😀' AS t, cast(null AS int) AS n"), str(tmp_path / "lines"))
    text = "".join(p.read_text() for p in (tmp_path / "lines").glob("*.json"))
    assert text.isascii() and json.loads(text) == {"t": "é😀", "n": None}


def test_sample(spark):
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") < 90, "a").otherwise("b").alias("s"))
    got = stratified_sample(rows, "s", "id", 11, seed=1)
    assert sorted(r.s for r in got.collect()) == ["a"] * 5 + ["b"] * 5
    with pytest.raises(ValueError):
        stratified_sample(rows, "s", "id", 30)
    with pytest.raises(ValueError):
        stratified_sample(rows, "s", "id", 1)


def test_plans(spark, sf):
    from judgeloom.plans import registry

    plan = registry.position_pair_summary(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "BroadcastNestedLoopJoin" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1
