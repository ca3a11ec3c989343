"""Ranked, explained list of entity-supplier pairs to review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from veedor.operators.isolation import fit_forest, normalized, with_anomaly
from veedor.operators.pairs import BURST_DAYS, MODEL_FEATURES, model_features, pair_features
from veedor.operators.quality import population_counts
from veedor.operators.quantiles import quantile_value
from veedor.operators.rules import BURST_MIN, clip01, explanation, rule_catalog, with_rules
from veedor.runtime import stage
from veedor.schema import PAIR_KEYS

RANKING_COLUMNS = (
    *PAIR_KEYS, "n_contratos", "suma_valor", "ratio_directa", "concentracion_entidad",
    "max_contratos_ventana", "score_final", "score_reglas", "score_anomalia",
    "reglas_disparadas", "razon_priorizacion", "alerta",
)


@dataclass(frozen=True)
class RiskOptions:
    """``contamination`` is accepted for compatibility: it only shifts the raw model score by
    a constant, which the min-max step removes."""

    seed: int = 42
    contamination: float = 0.05
    alert_percentile: float = 95.0
    weight_rules: float = 0.40
    weight_model: float = 0.60
    burst_days: int = BURST_DAYS
    burst_min: int = BURST_MIN
    min_pair_contracts: int = 2
    display_limit: int | None = 500

    def weights(self) -> tuple[float, float]:
        whole = max(self.weight_rules + self.weight_model, 1e-9)
        return self.weight_rules / whole, self.weight_model / whole


@dataclass(frozen=True)
class RiskResult:
    """``pairs``: features of all pairs; ``scored``: every pair large enough, with scores, alert
    and explanation."""

    contracts: DataFrame
    pairs: DataFrame
    scored: DataFrame
    options: RiskOptions
    cost_limit: Column
    n_scored: int

    @property
    def ranking(self) -> DataFrame:
        """The alerts of the display list."""
        return rank(self.scored, self.options.display_limit)

    @property
    def rules(self) -> DataFrame:
        return rule_catalog(self.scored.sparkSession)

    @property
    def run(self) -> DataFrame:
        """One row: contract counts, pair counts, thresholds and parameters."""
        wr, wm = self.options.weights()
        n_alerts = self.scored.where("alerta").count()
        n_pairs = self.pairs.count()  # staged: read from the files' footers
        return population_counts(self.contracts).withColumns(
            {
                "n_pairs": F.lit(n_pairs).cast("bigint"),
                "n_pairs_scored": F.lit(self.n_scored).cast("bigint"),
                "n_alerts": F.lit(n_alerts).cast("bigint"),
                "tasa_alerta": F.lit(n_alerts / max(1, self.n_scored)),
                "costo_dia_p90": self.cost_limit,
                "alert_percentile": F.lit(float(self.options.alert_percentile)),
                "weight_rules": F.lit(wr),
                "weight_if": F.lit(wm),
                "burst_window_days": F.lit(self.options.burst_days),
                "burst_min_contracts": F.lit(self.options.burst_min),
                "min_pair_contracts": F.lit(self.options.min_pair_contracts),
            }
        )


def _with_model(ruled: DataFrame, options: RiskOptions, n: int) -> DataFrame:
    inputs = model_features(ruled)
    forest = fit_forest(inputs, MODEL_FEATURES, PAIR_KEYS, seed=options.seed, n=n)
    raw = with_anomaly(inputs, MODEL_FEATURES, forest, "_crudo", n).drop(*MODEL_FEATURES)
    return normalized(stage(raw, "pair-scores"), "_crudo", "score_anomalia").drop("_crudo")


def score_pairs(
    pairs: DataFrame, options: RiskOptions, cost_limit: Column, n: int, anomaly: Column | None = None
) -> DataFrame:
    """Rules, model, blend, alert and explanation of the ``n`` pairs large enough.

    ``anomaly`` is a score from 0 to 1 of another model, taken in place of the forest's.

    ``pairs`` must be staged: it is read several times and thresholds must meet the very
    values they were taken from. With fewer than two pairs nothing is scored.
    """
    ruled = with_rules(large_pairs(pairs, options), cost_limit, options.burst_min)
    wr, wm = options.weights()
    if n < 2:
        modelled = ruled.where(F.lit(False)).withColumn("score_anomalia", F.lit(0.0))
    elif anomaly is not None:
        modelled = ruled.withColumn("score_anomalia", anomaly)
    elif wm > 0:
        modelled = _with_model(ruled, options, n)
    else:
        modelled = ruled.withColumn("score_anomalia", F.lit(0.0))
    blended = modelled.withColumn(
        "score_final", clip01(F.lit(wr) * F.col("score_reglas") + F.lit(wm) * F.col("score_anomalia"))
    )
    threshold = quantile_value(blended, "score_final", options.alert_percentile / 100.0)
    return blended.withColumns(
        {"alerta": F.col("score_final") >= threshold, "razon_priorizacion": explanation()}
    )


def large_pairs(pairs: DataFrame, options: RiskOptions) -> DataFrame:
    return pairs.where(F.col("n_contratos") >= options.min_pair_contracts)


def rank(scored: DataFrame, limit: int | None) -> DataFrame:
    """Alerts by score, ties by contracts and key."""
    alerts = scored.where("alerta").select(*RANKING_COLUMNS)
    ordered = alerts.orderBy(
        F.col("score_final").desc(), F.col("n_contratos").desc(),
        *[F.col(k).asc_nulls_last() for k in PAIR_KEYS],
    )
    return ordered if limit is None else ordered.limit(limit)


def run_risk(
    enriched: DataFrame, options: RiskOptions = RiskOptions(), anomaly: Column | None = None
) -> RiskResult:
    """The whole analysis over the contracts of one scope; ``anomaly`` as in ``score_pairs``."""
    pairs = stage(pair_features(enriched, options.burst_days), "pairs")
    large = large_pairs(pairs, options)
    n = large.count()
    cost_limit = quantile_value(large, "costo_dia_promedio", 0.90)
    scored = score_pairs(pairs, options, cost_limit, n, anomaly)
    return RiskResult(enriched, pairs, scored, options, cost_limit, n)
