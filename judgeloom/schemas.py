"""The records of the engine as Spark types, and checks that rows keep to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The members of each closed set, and the names of the records' fields.
VERDICT_LABELS = ["A", "B", "C", "tie"]
BIAS_TYPES = ["position", "authority", "bandwagon", "decoy", "control"]
CUE_CONGRUENCIES = ["control", "congruent", "incongruent", "none"]
OUTPUT_MODES = ["choice_only", "choice_with_confidence"]

_TEXT, _INT, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()
_META = T.MapType(_TEXT, _TEXT)


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CANDIDATE = _record(label=_TEXT, response=_TEXT, model_id=_TEXT, response_id=_TEXT)
JUDGE_EXAMPLE = _record(example_id=_TEXT, question_id=_TEXT, prompt_messages=T.ArrayType(_record(role=_TEXT, content=_TEXT)), candidates=T.MapType(_TEXT, CANDIDATE), human_winner=_TEXT, metadata=_META)
BIAS_CONDITION = _record(bias_type=_TEXT, variant_id=_TEXT, cue_target=_TEXT, cue_congruency=_TEXT, cue_text=_TEXT, decoy_anchor=_TEXT, metadata=_META)
PROMPT_PACKAGE = _record(prompt_text=_TEXT, output_mode=_TEXT, allowed_labels=T.ArrayType(_TEXT), prompt_hash=_TEXT, metadata=_META)
EXPERIMENT_SPEC = _record(dataset_name=_TEXT, dataset_split=_TEXT, model_name=_TEXT, backend_name=_TEXT, bias_name=_TEXT, output_mode=_TEXT, uncertainty_methods=T.ArrayType(_TEXT), consistency_runs=_INT, temperature=_REAL)
UNCERTAINTY_BUNDLE = _record(
    logit=_record(entropy=_REAL, msp=_REAL, margin=_REAL, normalized_entropy=_REAL), verbalized=_record(confidence=_REAL, uncertainty=_REAL),
    consistency=_record(run_count=_INT, agreement_rate=_REAL, vote_entropy=_REAL, unique_verdict_count=_INT, flip_rate=_REAL),
)
RUN_RECORD = _record(
    record_id=_TEXT, created_at=T.TimestampType(), spec=EXPERIMENT_SPEC, example_id=_TEXT, question_id=_TEXT, condition=BIAS_CONDITION, seed=_INT, verdict=_TEXT, raw_output=_TEXT, prompt_hash=_TEXT,
    uncertainty=UNCERTAINTY_BUNDLE, raw_prompt_logprobs=T.MapType(_TEXT, _REAL), metadata=_META,
)
#: Fields that may be null.
_OPTIONAL = {"human_winner", "cue_target", "cue_text", "decoy_anchor", "metadata"}
_CLOSED = {"human_winner": VERDICT_LABELS, "cue_target": VERDICT_LABELS, "decoy_anchor": VERDICT_LABELS, "bias_type": BIAS_TYPES, "cue_congruency": CUE_CONGRUENCIES, "output_mode": OUTPUT_MODES}


def fault(rows: DataFrame) -> Column:
    """The first thing that is wrong with a row, by the columns that ``rows`` has; null where nothing is.

    Candidates must not be empty, and each goes by a verdict label. Fields that aren't optional must not be null, and those
    of a closed set hold its members.
    """
    checks = []
    for field in JUDGE_EXAMPLE.fieldNames() + BIAS_CONDITION.fieldNames() + PROMPT_PACKAGE.fieldNames():
        if field not in rows.columns:
            continue
        c = F.col(field)
        if field == "candidates":
            checks.append(F.when(F.coalesce(F.size(c), F.lit(0)) < 1, "candidates must not be empty"))
            checks.append(F.when(~F.forall(F.map_keys(c), lambda k: k.isin(VERDICT_LABELS)), "candidates: unknown label"))
        elif field not in _OPTIONAL:
            checks.append(F.when(c.isNull(), f"{field} is missing"))
        if field in _CLOSED:
            checks.append(F.when(~c.isin(_CLOSED[field]), F.concat(F.lit(f"{field}: unknown value "), c)))
    return reduce(lambda x, y: F.coalesce(x, y), checks) if checks else F.lit(None).cast("string")


def checked(rows: DataFrame) -> DataFrame:
    """``rows`` as they are; an error where one is at fault."""
    bad = fault(rows)
    return rows.filter(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True)))
