"""Persona features, training, scoring and reports of one brand."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from clientele.config import (
    PERSONA_NAMES, WALLET_SPECS, WalletSpec,
)
from clientele.operators import contacts, features, personas, reports
from clientele.operators.moments import moments
from clientele.sources import io
from clientele.sources.staging import job, staged


def feature_table(tx: DataFrame, dropped: Iterable[str], outliers: Iterable[str],
                  specs: Iterable[WalletSpec] = WALLET_SPECS) -> DataFrame:
    """One row of shares per member, from a single aggregation of the sales."""
    table = features.wallet_features(features.clean_for_features(tx), specs).fillna(0)
    return features.exclude_members(table.drop(*dropped), outliers)


@job
def run_training(spark: SparkSession, mart_base: str, model_base: str, dropped: Iterable[str],
                 outliers: Iterable[str], k: int = 5, n_init: int = 5, n_factors: int = 10,
                 n_keep: int = 10, seed: int = 1,
                 specs: Iterable[WalletSpec] = WALLET_SPECS) -> list[str]:
    """Fit scaler and clusters on a mart; store both with the chosen features, and return these.

    Zero shares, scale and correlations all come from one pass over the stored features.
    """
    dropped = list(dropped)
    tx = io.read_transactions(spark, mart_base)
    table = staged(feature_table(tx, dropped, outliers, specs))
    seen = moments(table, features.feature_columns(table))
    cols = [c for c in seen.cols if seen.zero_shares[c] < 1.0]
    seen = seen.only(cols)
    scaler = seen.scaler(table)
    scaled = staged(features.standardize(table, cols, scaler))
    chosen = personas.ranked_features(seen.correlation, cols, n_factors, n_keep)
    model = personas.kmeans_fit(scaled, chosen, k, n_init, seed)
    io.save_model(model, scaler, chosen, model_base, dropped)
    io.write_personas(personas.kmeans_predict(scaled, chosen, model), f"{model_base}/training_result")
    return chosen


@job
def run_scoring(spark: SparkSession, mart_base: str, model_base: str, out_path: str,
                outliers: Iterable[str], refit: bool = False,
                specs: Iterable[WalletSpec] = WALLET_SPECS) -> None:
    """Assign personas with a stored model, its features in their order, on the training scale unless ``refit``."""
    model, scaler, cols, dropped = io.load_model(spark, model_base)
    table = feature_table(io.read_transactions(spark, mart_base), dropped, outliers, specs)
    if missing := set(cols) - set(table.columns):
        raise ValueError(f"features of the model that the specs do not make: {sorted(missing)}")
    scaled = features.standardize(table, cols, None if refit else scaler)
    io.write_personas(personas.kmeans_predict(scaled, cols, model), out_path)


def persona_reports(tx: DataFrame, named: DataFrame, window: tuple[date, date],
                    names: Mapping[int, str] = PERSONA_NAMES, brand: str = "BA") -> dict[str, DataFrame]:
    labels = list(names.values())
    sales, tags = contacts.clean_for_report(tx, brand), contacts.persona_tags(named)
    by_cat = {cat: reports.category_pivot(sales, tags, cat, window=window, names=labels)
              for cat in ("item_subcat_desc_cleaned", "maincat_desc_cleaned")}
    return {
        "counts": reports.persona_counts_wide(named, labels),
        "members": reports.members_bought(sales, tags, labels),
        "kpis": reports.sales_kpis(sales, tags, window, labels),
        **by_cat,
        **{f"{cat}_share": reports.column_share(table, cat, labels) for cat, table in by_cat.items()},
    }


@job
def run_persona_export(spark: SparkSession, mart_base: str, result_path: str, contacts_ref: str,
                       csv_path: str, run_date: date) -> None:
    """The contact list as CSV with header."""
    named = personas.name_personas(spark.read.parquet(result_path))
    preferences = contacts.latest_preferences(io.read_table(spark, contacts_ref))
    io.write_csv(contacts.contact_list(named, preferences, run_date), csv_path)
