"""Normalising, scoring and reading classifier output."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame

from flowsight.operators.features import flow_info
from flowsight.schema import (
    CLIP_VALUE,
    FEATURE_COLUMNS,
    FLOW_INFO_COLUMNS,
    N_CLASSES,
    NEAR_ZERO_STD,
    UNKNOWN,
)

NO_MODEL = f"array_repeat(0.0D, {N_CLASSES})"


def normalise(
    df: DataFrame,
    means: Sequence[float] | None,
    stds: Sequence[float] | None,
    clip: float | None = CLIP_VALUE,
    columns: Sequence[str] = FEATURE_COLUMNS,
) -> DataFrame:
    """(x - mean) / std per column, clipped to +-``clip``; a near-zero std counts as 1.

    Features stay raw when parameters are absent or their number does not match the columns.
    """
    if not means or not stds or len(means) != len(columns) or len(stds) != len(columns):
        return df
    scaled = {}
    for name, mean, std in zip(columns, means, stds):
        divisor = 1.0 if abs(std) < NEAR_ZERO_STD else float(std)
        value = f"({name} - {float(mean)!r}D) / {divisor!r}D"
        if clip and clip > 0:
            value = f"greatest(-{float(clip)!r}D, least({float(clip)!r}D, {value}))"
        scaled[name] = value
    return df.selectExpr(
        *[f"{scaled[c]} as {c}" if c in scaled else f"`{c}`" for c in df.columns]
    )


def normalise_vector(
    df: DataFrame,
    means: Sequence[float] | None,
    stds: Sequence[float] | None,
    clip: float | None = CLIP_VALUE,
    vector: str = "features",
) -> DataFrame:
    """The same for an array column; a row whose length differs from the parameters stays raw."""
    if not means or not stds or len(means) != len(stds):
        return df
    pairs = ", ".join(
        f"named_struct('mean', {float(m)!r}D, 'std', {1.0 if abs(s) < NEAR_ZERO_STD else float(s)!r}D)"
        for m, s in zip(means, stds)
    )
    value = "(x - p.mean) / p.std"
    if clip and clip > 0:
        value = f"greatest(-{float(clip)!r}D, least({float(clip)!r}D, {value}))"
    plain = f"cast({vector} as array<double>)"
    scaled = (
        f"case when size({vector}) = {len(means)}"
        f" then zip_with({plain}, array({pairs}), (x, p) -> {value}) else {plain} end"
    )
    keep = [c for c in df.columns if c != vector]
    return df.selectExpr(*keep, f"{scaled} as {vector}")


def interpret(df: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Class = position of the first maximum, confidence = the maximum; none or too far -> Unknown."""
    at = f"array_position({probabilities}, array_max({probabilities})) - 1"
    good = f"size({probabilities}) > 0 and {at} between 0 and {N_CLASSES - 1}"
    keep = [c for c in df.columns if c not in ("classification", "confidence")]
    return df.selectExpr(
        *keep,
        f"cast(case when {good} then {at} else {UNKNOWN} end as int) as classification",
        f"coalesce(array_max({probabilities}), 0.0D) as confidence",
    )


def score_by_port(flows: DataFrame) -> DataFrame:
    """Stand-in classifier: a destination port up to 1024 reads as SYN flood, others as benign, at 0.85."""
    hit = "case when destination_port <= 1024 then 11 else 0 end"
    probs = f"transform(sequence(0, {N_CLASSES - 1}), i -> case when i = {hit} then 0.85D else 0.0D end)"
    return interpret(flows.selectExpr("*", f"{probs} as probabilities"))


def score_with_model(
    df: DataFrame,
    load: Callable[[], Callable],
    columns: Sequence[str] = FEATURE_COLUMNS,
) -> DataFrame:
    """Add probabilities from a user model: ``load()`` runs once per task and returns matrix -> matrix.

    Batches arrive as Arrow, sized by spark.sql.execution.arrow.maxRecordsPerBatch; no shuffle.
    """
    names = list(columns)
    schema = df.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator) -> Iterator:
        model = load()
        for pdf in batches:
            if len(pdf):
                scores = model(pdf[names].to_numpy(dtype="float32"))
                yield pdf.assign(probabilities=[[float(p) for p in row] for row in scores])

    return interpret(df.mapInPandas(run, f"{out}, probabilities array<double>"))


def attach_predictions(flows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Left join by flow id; a flow without a prediction is Unknown with confidence 0."""
    clash = {"classification", "confidence", "probabilities"} & set(flows.columns)
    joined = flows.drop(*clash).join(
        predictions.select("flow_id", "classification", "confidence", "probabilities"),
        "flow_id",
        "left",
    )
    keep = [c for c in flows.columns if c not in clash]
    return joined.selectExpr(
        *keep,
        f"coalesce(classification, {UNKNOWN}) as classification",
        "coalesce(confidence, 0.0D) as confidence",
        f"coalesce(probabilities, {NO_MODEL}) as probabilities",
    )


def without_model(flows: DataFrame) -> DataFrame:
    """No classifier available: Unknown, confidence 0, all probabilities 0."""
    return flows.selectExpr(
        "*",
        f"{UNKNOWN} as classification",
        "0.0D as confidence",
        f"{NO_MODEL} as probabilities",
    )


def attach_results(results: DataFrame, flows: DataFrame) -> DataFrame:
    """Results with their flow's metadata by id; a result without a flow gets empty metadata."""
    info = flow_info(flows)
    joined = results.join(info, "flow_id", "left")
    kinds = dict(info.dtypes)
    filled = [
        f"coalesce({c}, {repr('') if kinds[c] == 'string' else 0}) as {c}" for c in FLOW_INFO_COLUMNS
    ]
    return joined.selectExpr(*results.columns, *filled)
