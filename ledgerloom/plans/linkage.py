"""Whole plans: from raw records to match lists, and the evaluation of such plans."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_records
from ledgerloom.operators import decide, features, keys, learn, retrieval, splits
from ledgerloom.operators import metrics as M

#: Families of features, by the names that configurations have for them.
FAMILIES = {"STR": ("name",), "RARE": ("token",), "NUM": ("number",), "ADDR": ("address",), "LEGAL": ("legal",), "TXT": ("text",), "RET": ("retrieval",), "CTX": ("context",), "XTRA": ("extra", "extra_context"), "DENSE": ("dense",)}
FULL = ("STR", "RARE", "NUM", "ADDR", "LEGAL", "TXT", "RET", "CTX")
#: Columns of the families LEGAL and TXT, which are together in ``features.FAMILIES``.
OTHER = {"legal": ("is_s3", "legal_state", "legal_eq", "legal_conflict"), "text": ("phone_eq", "phone_conflict", "domain_eq", "domain_conflict")}


@dataclass(frozen=True)
class Settings:
    """A linkage run: retrieval and its truncation, features, matcher, training rows, calibration, policy, assignment.

    ``kind``: ``empty`` links nothing, ``oracle`` all true candidates, ``rule`` by the retrieval's score, ``model`` by a matcher.
    ``params`` are the matcher's settings, or the name of what ``resolve`` finds them by."""

    name: str = "default"
    parent: str | None = None
    kind: str = "model"
    passes: tuple[retrieval.Pass, ...] = retrieval.WIDE
    limits: tuple[tuple[str, int], ...] = (("all", 20), ("name", 10), ("addr", 10))
    least: float = 0.05
    families: tuple[str, ...] = ("STR", "RET")
    matcher: str = "gbt"
    params: str | tuple[tuple[str, object], ...] = "default"
    negatives: str = "E0"
    singleton_weight: float = 3.0
    calibration: str = "isotonic"
    policy: str = "A"
    unique: bool = False
    dense: bool = False

    @property
    def columns(self) -> list[str]:
        found = []
        for f in (*self.families, *(("DENSE",) if self.dense else ())):
            for name in FAMILIES[f]:
                found += OTHER.get(name) or features.FAMILIES[name]
        return list(dict.fromkeys(found))


def pipelines(vectors: bool = False) -> list[Settings]:
    """The named runs: each adds one thing to its parent."""
    base = Settings(families=FULL, negatives="E2", policy="B")
    out = [
        Settings("P-empty", kind="empty"),
        Settings("P-oracle", kind="oracle"),
        Settings("P-rule", kind="rule"),
        Settings("P0", "P-rule"),
        Settings("P0-lr", "P0", matcher="lr"),
        Settings("P1", "P0", families=("STR", "RARE", "NUM", "RET")),
        Settings("P2", "P1", families=FULL),
        replace(base, name="P4", parent="P2"),
        replace(base, name="P4-E1", parent="P4", negatives="E1"),
        replace(base, name="P4-C", parent="P4", policy="C"),
        replace(base, name="P5-wide", parent="P4", limits=(("all", 50), ("name", 30), ("addr", 30))),
        replace(base, name="P8", parent="P4", unique=True),
        replace(base, name="P9", parent="P4", families=(*FULL, "XTRA"), unique=True),
    ]
    return [*out, replace(base, name="P6", parent="P4", dense=True)] if vectors else out


def resolve(settings: Settings, studies: dict[str, dict] | None = None) -> dict:
    """The matcher's parameters: its own, none for ``default``, for ``hpo`` those of a study of the matcher (params and robust_score)."""
    if settings.params == "default":
        return {}
    if settings.params != "hpo":
        return dict(settings.params)
    if not studies or settings.matcher not in studies:
        raise KeyError(f"no study of the matcher {settings.matcher}")
    return dict(studies[settings.matcher]["params"])


def passes_for(settings: Settings) -> tuple[retrieval.Pass, ...]:
    """The passes that retrieve a truncated run's candidates at once: its limits, and of each pass's least score and its own the larger."""
    limits = dict(settings.limits)
    return tuple(replace(p, k=min(p.k, limits[p.name]), least=max(p.least, settings.least)) for p in settings.passes if limits.get(p.name))


def wide_candidates(queries: DataFrame, pool: DataFrame, settings: Settings = Settings(), truth: DataFrame | None = None) -> DataFrame:
    """All passes' candidates of cleaned records, with each one's score and rank, ``source`` (the pool id's prefix) and, given ``truth`` (q, p), ``label``."""
    q, p = (keys.exploded(keys.record_keys(r)) for r in (queries, pool))
    wide = retrieval.union_passes(retrieval.retrieve(q, p, pool, settings.passes), [x.name for x in settings.passes])
    wide = wide.withColumn("source", F.substring(F.col("p").cast("string"), 1, 2))
    return wide if truth is None else labelled(wide, truth)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("q", "p").distinct().withColumn("label", F.lit(1)), ["q", "p"], "left").fillna(0, ["label"])


def candidates(queries: DataFrame, pool: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Candidate pairs of cleaned records within the run's limits, with each pass's score and rank (null where it is left out)."""
    cut = retrieval.truncate(wide_candidates(queries, pool, settings), {k: v for k, v in settings.limits if v}, settings.least)
    missing = {f"{c}_{x.name}": F.lit(None).cast(t) for x in settings.passes for c, t in (("score", "double"), ("rank", "int")) if f"{c}_{x.name}" not in cut.columns}
    return cut.withColumns(missing) if missing else cut


def candidate_scope(queries: DataFrame, pairs: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(q, n_candidates, n_true, n_found) of every query, those without candidates too."""
    out = queries.select("q").join(pairs.groupBy("q").agg(F.count("*").alias("n_candidates")), "q", "left").fillna(0, ["n_candidates"])
    if truth is None:
        return out
    per = retrieval.hits(pairs, truth).groupBy("q").agg(F.count("*").alias("n_true"), F.sum("hit").alias("n_found"))
    return out.join(per, "q", "left").fillna(0, ["n_true", "n_found"])


@dataclass
class Bundle:
    """A fitted run, to be applied to other queries."""

    settings: Settings
    policy: decide.Policy
    model: PipelineModel | None = None
    calibrator: learn.Calibrator | None = None
    calibrators: dict[str, learn.Calibrator] = field(default_factory=dict)
    singletons: learn.Singletons | None = None


def fit_bundle(settings: Settings, pairs: DataFrame, entities: DataFrame, seed: int = 0, studies: dict[str, dict] | None = None) -> Bundle:
    """Fit a run on labelled candidate ``pairs`` (q, p, score, label and features) of ``entities`` (q, g).

    Queries, with all their pairs, are dealt 70:15:15: the matcher is trained on the first part (a tenth of it stops the trees), calibrated
    on the second, where the model of singletons is fitted too, and the policy is tuned on the third."""
    if settings.kind in ("empty", "oracle"):
        return Bundle(settings, decide.Policy(t=float("inf")))
    dealt = splits.roles(entities.select("q", "g"), "q", {"fit": 0.7, "cal": 0.15, "tune": 0.15}, str(seed))
    part = lambda role: pairs.join(dealt.where(F.col("role") == role).select("q"), "q", "left_semi")
    of = lambda role: dealt.where(F.col("role") == role).select("q", "g")
    if settings.kind == "rule":
        rest = dealt.where("role <> 'fit'").select("q", "g")
        return Bundle(settings, decide.fit_policy("A", pairs.join(rest.select("q"), "q", "left_semi"), rest))
    missing = [c for c in settings.columns if c not in pairs.columns]
    if missing:
        raise KeyError(f"the pairs lack features of {settings.name}: {missing}")
    rows = splits.training_rows(part("fit"), settings.negatives, of("fit"), weight=settings.singleton_weight, seed=str(seed))
    stops = splits.roles(of("fit"), "q", {"train": 0.9, "held": 0.1}, str(seed + 1)).select("q", (F.col("role") == "held").alias("held"))
    model = learn.fit(rows.join(stops, "q"), settings.columns, settings.matcher, held="held", **resolve(settings, studies))
    raw = learn.predict(model, part("cal"), settings.columns)
    calibrators = {k: learn.Calibrator(k).fit(raw) for k in ("none", "platt", "isotonic", "beta")}
    bundle = Bundle(settings, decide.Policy(), model, calibrators[settings.calibration], calibrators)
    if settings.policy != "A":
        context = learn.entity_context(bundle.calibrator.apply(raw, "prob_c").drop("prob").withColumnRenamed("prob_c", "prob"), entities=of("cal"))
        bundle.singletons = learn.Singletons().fit(context.join(of("cal"), "q").withColumn("label", (F.col("g") > 0).cast("int")))
    tuned = _scored(bundle, part("tune"), of("tune"))
    matches = tuned.select("q", "p", F.col("prob").alias("score"), "label", *(c for c in ("conflict_count",) if c in tuned.columns))
    tune = of("tune")
    if bundle.singletons is not None:
        tune = tune.join(_any_match(bundle, tuned, tune), "q")
    bundle.policy = decide.fit_policy(settings.policy, matches, tune)
    return bundle


def _any_match(bundle: Bundle, scored: DataFrame, entities: DataFrame) -> DataFrame:
    return bundle.singletons.apply(learn.entity_context(scored, entities=entities))


def _scored(bundle: Bundle, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """``pairs`` with ``raw`` and the calibrated ``prob``."""
    raw = learn.predict(bundle.model, pairs, bundle.settings.columns)
    return bundle.calibrator.apply(raw, "_p").withColumnRenamed("prob", "raw").withColumnRenamed("_p", "prob")


def apply_bundle(bundle: Bundle, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """``pairs`` with raw, prob, any_match (null without a model of it) and ``pred``; no labels are needed but by ``oracle``."""
    none = F.lit(None).cast("double")
    kind = bundle.settings.kind
    if kind in ("empty", "oracle"):
        hit = (F.col("label") == 1) if kind == "oracle" else F.lit(False)
        return pairs.withColumns({"raw": none, "prob": hit.cast("double"), "any_match": none, "pred": hit})
    if kind == "rule":
        out = pairs.withColumns({"raw": F.col("score"), "prob": F.col("score"), "any_match": none, "pred": F.col("score") >= bundle.policy.t})
    else:
        out = _scored(bundle, pairs, entities)
        out = out.join(_any_match(bundle, out, entities), "q", "left") if bundle.singletons is not None else out.withColumn("any_match", none)
        given = out.select("q", "p", F.col("prob").alias("score"), "any_match", *(c for c in ("conflict_count",) if c in out.columns))
        out = out.join(decide.apply_policy(bundle.policy, given).select("q", "p", "pred"), ["q", "p"])
    if not bundle.settings.unique:
        return out
    kept = decide.unique_assignment(out.where("pred").select("q", "p", F.col("prob").alias("score"))).select("q", "p", F.lit(True).alias("_kept"))
    return out.join(kept, ["q", "p"], "left").withColumn("pred", F.coalesce("_kept", F.lit(False))).drop("_kept")


def evaluate(settings: Settings, pairs: DataFrame, entities: DataFrame, seed: int = 0, studies: dict[str, dict] | None = None) -> DataFrame:
    """Out-of-fold predictions: for each value of ``fold`` of ``entities`` (q, g, fold), ``pairs`` by a bundle fitted on the others."""
    out = None
    for f in sorted(r.fold for r in entities.select("fold").distinct().collect()):  # a row for each fold
        mine, others = entities.where(F.col("fold") == f), entities.where(F.col("fold") != f)
        bundle = fit_bundle(settings, pairs.join(others.select("q"), "q", "left_semi"), others, seed + int(f), studies)
        found = apply_bundle(bundle, pairs.join(mine.select("q"), "q", "left_semi"), mine).withColumn("fold", F.lit(int(f)))
        out = found if out is None else out.unionByName(found)
    return out


def report(predicted: DataFrame, entities: DataFrame, slices: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """What is told of a run's predictions (q, p, label, prob, pred): headline, by fold, interval, losses, slices, calibration, reliability, curve."""
    table = M.entity_table(entities, predicted)
    scored = predicted.withColumn("score", F.round("prob", 9))
    found = {
        "overall": M.summary(table),
        "interval": M.bootstrap_ci(table),
        "loss": M.loss_parts(table),
        "calibration": learn.calibration_error(predicted, "prob"),
        "threshold": M.thinned(M.threshold_curve(scored, entities), "t", "macro_f05"),
        "reliability": scored.groupBy(F.least(F.floor(F.col("score") * 20), F.lit(19)).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("predicted"), F.avg("label").alias("observed")),
    }
    if "fold" in entities.columns:
        found["folds"] = table.groupBy("fold").agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.count("*").alias("n"))
    for by in slices:
        found[f"by_{by}"] = table.groupBy(by).agg(F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.avg("ceiling_f05"), 6).alias("ceiling_f05"), F.count("*").alias("n"))
    return found


def cross_country(settings: Settings, pairs: DataFrame, entities: DataFrame, least: int = 200, seed: int = 0) -> list[dict]:
    """Macro F0.5 of each country of ``least`` entities (q, g, country) or more by a bundle of each other one."""
    names = sorted(r.country for r in entities.groupBy("country").count().where(F.col("count") >= least).collect())
    of = {c: entities.where(F.col("country") == c) for c in names}
    mine = lambda c: pairs.join(of[c].select("q"), "q", "left_semi")
    out = []
    for train in names:
        bundle = fit_bundle(settings, mine(train), of[train], seed)
        for other in names:
            if other != train:
                found = M.entity_table(of[other], apply_bundle(bundle, mine(other), of[other]))
                out.append({"train": train, "eval": other, "macro_f05": M.summary(found).first().macro_f05})
    return out


def features_of(queries: DataFrame, pool: DataFrame, settings: Settings = Settings(), truth: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Candidate pairs of cleaned records with all families' features and, given ``truth``, ``label``."""
    out = features.full_table(candidates(queries, pool, settings), queries, pool, vectors)
    return out if truth is None else labelled(out, truth)


def link(bundle: Bundle, queries: DataFrame, pool: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(q, ids): the match list of every raw query record by a fitted bundle; nothing about them need be known."""
    queries, pool = clean_records(queries), clean_records(pool)
    entities = queries.select(F.col("entity_id").alias("q"))
    if bundle.settings.kind == "rule":
        pairs = candidates(queries, pool, bundle.settings)
    else:
        pairs = features_of(queries, pool, bundle.settings, vectors=vectors)
    links = apply_bundle(bundle, pairs, entities).where("pred").select("q", "p", F.col("prob").alias("score"))
    return decide.match_lists(entities, links)


def describe(settings: Settings) -> dict:
    """The settings as plain values, for a run's file."""
    return asdict(settings)
