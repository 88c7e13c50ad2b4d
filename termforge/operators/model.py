"""Linear models over conjunctions of feature thresholds: loading, checking, planning, scoring, ranking, explaining."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions.scores import sigmoid
from termforge.plans.tables import BROADCAST_BYTES, cut, fits_broadcast

FORMAT = "monomial_linear_v1"
GREATER = "GT"
_MAX_FLOAT = 3.4028234663852886e38


@dataclass(frozen=True)
class Split:
    feature: str
    border: float


@dataclass(frozen=True)
class Monomial:
    coefficient: float
    splits: tuple[Split, ...]


@dataclass(frozen=True)
class Model:
    intercept: float
    features: tuple[str, ...]
    monomials: tuple[Monomial, ...]

    @property
    def bounds(self) -> tuple[float, float]:
        """The least and the greatest score."""
        return self.intercept + sum(min(m.coefficient, 0.0) for m in self.monomials), self.intercept + sum(max(m.coefficient, 0.0) for m in self.monomials)

    def used_features(self) -> set[str]:
        return {s.feature for m in self.monomials for s in m.splits}


def _finite(x: object, what: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise ValueError(f"{what} must be a finite number, not {x!r}")
    return float(x)


def parse_model(source: str | dict) -> Model:
    """A checked model from its JSON: format, finite numbers, unique names, agreeing indexes and names, only GT."""
    data = json.loads(source) if isinstance(source, str) else source
    if data.get("format") != FORMAT:
        raise ValueError(f"unknown model format {data.get('format')!r}")
    names = list(data["feature_names"])
    if len(set(names)) != len(names):
        raise ValueError("feature names repeat")
    monomials = []
    for m in data["monomials"]:
        splits = []
        for s in m["splits"]:
            if s.get("comparison") != GREATER:
                raise ValueError(f"unknown comparison {s.get('comparison')!r}")
            at = s["feature_idx"]
            if not isinstance(at, int) or not 0 <= at < len(names) or names[at] != s["feature_name"]:
                raise ValueError(f"feature {s.get('feature_name')!r} is not at {at!r}")
            splits.append(Split(s["feature_name"], _finite(s["border"], "border")))
        monomials.append(Monomial(_finite(m["trained_coef"], "trained_coef"), tuple(splits)))
    model = Model(_finite(data["intercept"], "intercept"), tuple(names), tuple(monomials))
    low, high = model.bounds
    if not (math.isfinite(low) and math.isfinite(high) and high - low <= _MAX_FLOAT):
        raise ValueError("the scores' range is too wide")
    return model


def read_model(path: str) -> Model:
    with open(path, encoding="utf-8") as file:
        return parse_model(file.read())


class Conditions:
    """``feature > border`` as Columns, remembered by name and exact border; unknown names are errors."""

    def __init__(self, columns: dict[str, Column], constants: dict[str, float] | None = None) -> None:
        self.columns, self.constants = columns, constants or {}
        self._known: dict[tuple[str, str], Column | bool] = {}

    def greater(self, feature: str, border: float) -> Column | bool:
        """A Column, or a plain truth value for features whose value is known while planning (those of a single query)."""
        border = _finite(border, "border")
        key = feature, float(border).hex()
        if key not in self._known:
            if feature in self.constants:
                self._known[key] = self.constants[feature] > border
            elif feature in self.columns:
                self._known[key] = self.columns[feature] > F.lit(border)
            else:
                raise KeyError(f"unknown feature {feature!r}")
        return self._known[key]

    def all_of(self, splits: tuple[Split, ...]) -> Column | bool:
        """The conjunction: known truths are left out, a known falsehood makes it false."""
        parts = [self.greater(s.feature, s.border) for s in splits]
        if any(p is False for p in parts):
            return False
        columns = [p for p in parts if p is not True]
        return reduce(lambda a, b: a & b, columns) if columns else True


def compare(value: Column, comparison: str, border: float) -> Column:
    """A feature against a border by one of GT, LT, GE, LE; single-precision values are widened, the border is not rounded."""
    border_ = F.lit(_finite(border, "border"))
    return {"GT": value > border_, "LT": value < border_, "GE": value >= border_, "LE": value <= border_}[comparison]


def score_column(model: Model, conditions: Conditions) -> Column:
    """intercept + coefficients of the conjunctions that hold, in the model's order, in double precision."""
    total: Column = F.lit(model.intercept)
    for m in model.monomials:
        holds = conditions.all_of(m.splits)
        if m.coefficient == 0.0 or holds is False:
            continue
        total = total + (F.lit(m.coefficient) if holds is True else F.when(holds, F.lit(m.coefficient)).otherwise(F.lit(0.0)))
    return total


def candidate_condition(model: Model, conditions: Conditions, threshold: float) -> Column | None:
    """What a document must meet to score above the threshold at all: one positive conjunction if the intercept alone does not reach it.

    None if nothing can be said; a false literal if no conjunction can hold.
    """
    if threshold < model.intercept:
        return None
    positive = [conditions.all_of(m.splits) for m in model.monomials if m.coefficient > 0]
    if any(p is True for p in positive):
        return None
    columns = [p for p in positive if p is not False]
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def scored(rows: DataFrame, model: Model, threshold: float, conditions: Conditions | None = None) -> DataFrame:
    """Rows with ``score`` strictly above the threshold; columns named as the features are used unless conditions are given."""
    threshold = _finite(threshold, "threshold")
    conditions = conditions or Conditions({c: F.col(c) for c in rows.columns})
    candidates = candidate_condition(model, conditions, threshold)
    kept = rows if candidates is None else rows.where(candidates)
    return kept.withColumn("score", score_column(model, conditions)).where(F.col("score") > F.lit(threshold))


def ranked(rows: DataFrame, model: Model, threshold: float, k: int, order: str = "doc_id", conditions: Conditions | None = None) -> DataFrame:
    """The best ``k`` by the score shifted to start at 0 and rounded to single precision; ties by ``order``. With ``probability``."""
    if k <= 0:
        raise ValueError("k must be positive")
    low = model.bounds[0]
    key = F.greatest(F.lit(0.0), F.col("score") - F.lit(low)).cast("float")
    return scored(rows, model, threshold, conditions).withColumn("probability", sigmoid(F.col("score"))).orderBy(key.desc(), order).limit(k)


def first_matches(rows: DataFrame, model: Model, threshold: float, n: int, order: str | None = "doc_id", conditions: Conditions | None = None) -> DataFrame:
    """The first ``n`` above the threshold in index order; without ``order`` any ``n``, which lets the scan stop early."""
    if n <= 0:
        raise ValueError("n must be positive")
    hits = scored(rows, model, threshold, conditions)
    return (hits.orderBy(order) if order else hits).limit(n)  # with an order a bounded top-n per task, no full sort


def explained(rows: DataFrame, model: Model, conditions: Conditions | None = None) -> DataFrame:
    """Rows with ``active``: the places and coefficients of the conjunctions that hold, and the score."""
    conditions = conditions or Conditions({c: F.col(c) for c in rows.columns})
    parts = []
    for i, m in enumerate(model.monomials):
        holds = conditions.all_of(m.splits)
        parts.append(F.struct(F.lit(i).alias("monomial"), F.lit(m.coefficient).alias("coefficient"), (F.lit(holds) if isinstance(holds, bool) else holds).alias("active")))
    active = F.filter(F.array(*parts), lambda x: x["active"]) if parts else F.array().cast("array<struct<monomial:int,coefficient:double,active:boolean>>")
    return rows.withColumn("active", active).withColumn("score", score_column(model, conditions))


def hit_count(rows: DataFrame, limit: int | None = None) -> tuple[int, str]:
    """The number of hits and how exact it is: with a limit that was reached, only a lower bound."""
    n = (rows.limit(limit) if limit else rows).count()
    return n, "GREATER_THAN_OR_EQUAL_TO" if limit and n == limit else "EQUAL_TO"


def known_monomials(splits: DataFrame, names: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The splits of monomials whose features all are among ``names``, and the others as ``model_id, monomial_no, unknown`` (splits that name none).

    ``strict`` makes a monomial with an unknown feature an error as soon as the rows are read.
    """
    known = F.coalesce(F.col("feature_name").isin(list(names)), F.lit(False))
    if strict:
        splits = splits.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown feature "), F.coalesce("feature_name", F.lit("null")))).cast("boolean")))
    unknown = splits.groupBy("model_id", "monomial_no").agg(F.count_if(~known).alias("unknown"))
    key = ["model_id", "monomial_no"]
    return splits.join(unknown.where("unknown = 0").select(*key), key, "left_semi"), unknown.where("unknown > 0")


def model_table_scores(splits: DataFrame, features: DataFrame, key: str, intercept: float = 0.0) -> DataFrame:
    """Scores of many models at once, the models being rows (``model_id, monomial_no, trained_coef, feature_name, border``).

    ``features`` is long: ``key``, ``feature_name``, ``value``, and holds every feature that the splits name (see ``known_monomials``). A
    conjunction holds if all its splits do. The splits are the smaller side of the join and carry the model, so rows of one record spread over
    tasks by feature. Null borders are never met.
    """
    sizes = splits.groupBy("model_id", "monomial_no").agg(F.count(F.lit(1)).alias("splits"), F.max("trained_coef").alias("coefficient"))
    met = features.join(splits.select("model_id", "monomial_no", "feature_name", "border"), "feature_name").where(F.col("value") > F.col("border"))
    held = met.groupBy(key, "model_id", "monomial_no").agg(F.count(F.lit(1)).alias("met")).join(sizes, ["model_id", "monomial_no"]).where("met = splits")
    return held.groupBy(key, "model_id").agg((F.lit(intercept) + F.sum("coefficient")).alias("score"))


#: Splits times rows that are compared at once, and rows of a batch that is sent on.
_CELLS, _FLUSH = 4_000_000, 100_000


def _scores(models: list[str], of: np.ndarray, coefficients: np.ndarray, first: np.ndarray, features: np.ndarray, borders: np.ndarray, intercept: float) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and models with a conjunction that holds, and their scores (with a mask of null ones), of a matrix of features by rows. Splits stand by model and monomial; ``first`` split and
    model (``of``) by monomial."""
    order = np.argsort(features, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    used, starts = np.unique(features[order], return_index=True)
    spans = list(zip(used.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True))
    borders = borders[order]
    model_starts = np.searchsorted(of, np.arange(len(models)))
    missing = np.isnan(coefficients)
    weights = np.where(missing, 0.0, coefficients)[:, None]

    def scores(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        met = np.empty((len(order), values.shape[1]), np.bool_)
        for f, a, b in spans:
            limit = borders[a:b, None]
            np.greater(values[f][None, :], limit, out=met[a:b])
            if np.isnan(values[f]).any():  # above every number, as in SQL
                met[a:b] |= np.isnan(values[f])[None, :] & ~np.isnan(limit)
        held = np.logical_and.reduceat(met[at], first, axis=0)
        rows, found = np.nonzero(np.logical_or.reduceat(held, model_starts, axis=0).T)
        total = intercept + np.add.reduceat(np.where(held, weights, 0.0), model_starts, axis=0)
        none = np.zeros(len(rows), np.bool_)
        if missing.any():
            none = ~np.logical_or.reduceat(held & ~missing[:, None], model_starts, axis=0)[found, rows]
        return rows, found, np.ma.array(total[found, rows], mask=none)

    return scores


def table_scores(splits: DataFrame, rows: DataFrame, names: list[str], intercept: float = 0.0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``model_table_scores`` of wide rows: their other columns, ``model_id`` and ``score``. No row is made of a record and a split: a task compares the features of some rows with all splits.

    Splits that are not small enough to be sent to every task (``limit``) are joined.
    """
    key = [c for c in rows.columns if c not in names]
    splits = cut(splits.select("model_id", "monomial_no", "trained_coef", "feature_name", "border"), "splits")
    if not fits_broadcast(splits, 128, limit):
        long = F.explode(F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")
        features = rows.select(F.struct(*key).alias("key"), long).select("key", "x.*")
        return model_table_scores(splits, features, "key", intercept).select("key.*", "model_id", "score")
    table = splits.orderBy("model_id", "monomial_no").toArrow()
    spark, kinds = rows.sparkSession, rows.select(*key).schema
    context, number = spark.sparkContext, {n: i for i, n in enumerate(names)}
    models, of, first, coefficients, last = [], [], [], [], None
    for i, (m, n, c) in enumerate(zip(table["model_id"].to_pylist(), table["monomial_no"].to_pylist(), table["trained_coef"].to_pylist(), strict=True)):
        if not models or models[-1] != m:
            models.append(m)
        if last != (m, n):
            last = m, n
            of.append(len(models) - 1)
            first.append(i)
            coefficients.append(math.nan)
        if c is not None and not coefficients[-1] >= c:  # the greatest of the monomial's
            coefficients[-1] = c
    numbers = np.array([number[n] for n in table["feature_name"].to_pylist()], np.int64)
    borders = np.array([math.nan if b is None else b for b in table["border"].to_pylist()], np.float64)
    sent = context.broadcast((models, np.array(of, np.int64), np.array(coefficients, np.float64), np.array(first, np.int64), numbers, borders, intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, *rest = sent.value
        scores, ids = _scores(models, *rest) if models else None, pa.array(models, pa.string())
        step = max(1, _CELLS // max(1, len(rest[3])))
        out, size = [], 0
        for batch in batches if models else ():
            # a null is met by no split
            values = np.stack([batch.column(n).cast(pa.float64()).fill_null(-math.inf).to_numpy(zero_copy_only=False) for n in names])
            for a in range(0, batch.num_rows, step):
                at, found, total = scores(values[:, a : a + step])
                columns = [batch.column(c).take(pa.array(at + a)) for c in key]
                out.append(pa.RecordBatch.from_arrays([*columns, ids.take(pa.array(found)), pa.array(total.data, mask=total.mask)], names=[*key, "model_id", "score"]))
                size += len(at)
                if size > _FLUSH:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, size = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    rows = cut(rows, "features")
    spread = rows.repartition(max(2 * context.defaultParallelism, rows.count() // 20_000))
    return spread.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kinds)}, model_id string, score double")


@dataclass(frozen=True)
class Candidates:
    """What a candidate provider gives: entries of a query, best first, and how many were found in all."""

    entries: list[tuple[str, float]]
    found: int


def provider(search: Callable[[str], DataFrame], most: int) -> Callable[[str], Candidates]:
    """A search that gives ``doc_id, score`` rows as a candidate provider: at most ``most`` entries with single-precision scores, sorted by score and id."""
    if most <= 0:
        raise ValueError("most must be positive")

    def candidates(query: str) -> Candidates:
        rows = search(query).select("doc_id", F.col("score").cast("float").alias("score"))
        best = rows.orderBy(F.desc("score"), "doc_id").limit(most).collect()
        return Candidates([(r["doc_id"], r["score"]) for r in best], len(best) if len(best) < most else rows.count())

    return candidates
