"""Whole runs: train, generate, post-process, check; and their command line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalars import col
from tabloom.operators import privacy, rules, validate
from tabloom.operators.profile import Schema, distinct_rows, infer_schema
from tabloom.operators.select import DEFICIT_BIAS, MISSINGNESS_WEIGHT, first_rows, select_rows
from tabloom.plans import clinical
from tabloom.session import checkpoint, session
from tabloom.sources import tables
from tabloom.sources.tables import ROW

ATTEMPTS, OVERSAMPLE = 4, 1.1
#: The default share of an excess of filled cells that post-processing removes.
STRENGTH = 0.05


def generate(spark: SparkSession, model, real: DataFrame, schema: Schema, constraints: rules.Constraints, rows: int, repair: bool = True, privacy_filter: bool = True, min_distance: float = 0.0, min_distance_quantile: float | None = None, oversample: float = OVERSAMPLE, attempts: int = ATTEMPTS, strategy: str = "head", order: str = ROW, most: int = 12, missing_weight: float = MISSINGNESS_WEIGHT, bias: float = DEFICIT_BIAS, seed: int | None = 42) -> DataFrame:
    """``rows`` new rows: drawn with some to spare, repaired, freed of privacy violations and duplicates, and selected; drawn
    again, at most ``attempts`` times, while rows are lacking.  Every step is checkpointed: later steps ask it often."""
    kept, start = None, 0
    for _ in range(attempts):
        lacking = rows - (kept.count() if kept is not None else 0)
        if lacking <= 0:
            break
        size = max(round(lacking * oversample), lacking)
        batch = checkpoint(model.sample(spark, size, start, order))
        start += size
        if repair:
            batch = checkpoint(rules.repair(batch, constraints, order))
        if privacy_filter:
            batch = privacy.filter_violations(real, batch, schema, order, min_distance, min_distance_quantile)
        pool = batch if kept is None else kept.unionByName(batch)
        pool = checkpoint(distinct_rows(pool, order))
        options = {"most": most, "missing_weight": missing_weight, "bias": bias, "seed": seed} if strategy == "balanced" else {}
        kept = checkpoint(select_rows(pool, real, schema, order, rows, strategy, **options))
    if kept is None:
        raise ValueError("at least one attempt is needed")
    return first_rows(kept, order, rows).select(order, *[col(c) for c in schema.order])


def model_names(config: dict) -> list[str]:
    """The list of models, else the one model, else the copula."""
    return list(config.get("models") or [config.get("model") or "copula"])


def _load(spark: SparkSession, source: str) -> tuple[DataFrame, Schema]:
    real = checkpoint(tables.read_csv(spark, source))
    return real, infer_schema(real, ROW)


def _rules(real: DataFrame, schema: Schema, config: dict) -> rules.Constraints:
    return clinical.constraints(real, schema, config.get("include_conditional_blanks", False), config.get("derived_repair_mode", "overwrite"))


def train(spark: SparkSession, source: str, config: dict, out: str) -> dict[str, str]:
    """Fits every model of the configuration and stores it; gives their files."""
    real, schema = _load(spark, source)
    tables.write_json(schema.to_dict(), f"{out}/schema.json")
    found = {}
    for name in model_names(config):
        model = tables.create_model(name, config.get("seed", 42)).fit(real, schema, ROW, tables.model_config(config, name))
        found[name] = f"{out}/{name}.json"
        tables.save_model(model, found[name])
    tables.write_json({"models": found, "rows": schema.row_count, "columns": len(schema.columns)}, f"{out}/training_summary.json")
    return found


def _options(config: dict) -> dict:
    return {
        "repair": config.get("repair", True), "privacy_filter": config.get("privacy_filter", True), "min_distance": config.get("privacy_min_distance", 0.0),
        "min_distance_quantile": config.get("privacy_min_distance_quantile"), "oversample": config.get("oversample_factor", OVERSAMPLE), "attempts": config.get("max_attempts", ATTEMPTS),
        "strategy": config.get("selection_strategy", "head"), "most": config.get("selection_max_unique", 12), "missing_weight": config.get("selection_missingness_weight", MISSINGNESS_WEIGHT),
        "bias": config.get("selection_deficit_bias", DEFICIT_BIAS), "seed": config.get("selection_seed", 42),
    }


def generate_from(spark: SparkSession, source: str, artifact: str, config: dict, out: str, rows: int | None = None, seed: int | None = None) -> list[str]:
    """Rows from a stored model, written, checked and noted; gives the errors."""
    real, schema = _load(spark, source)
    model = tables.load_model(artifact)
    model.seed = model.seed if seed is None else seed
    own = tables.model_config(config, model.name)
    made = generate(spark, model, real, schema, _rules(real, schema, own), rows or schema.row_count, **_options(own))
    return _deliver(made, real, schema, out, {"model": model.name, "artifact": artifact, "seed": model.seed})


def _deliver(made: DataFrame, real: DataFrame, schema: Schema, out: str, facts: dict) -> list[str]:
    path, errors = tables.write_validated(made, real, schema, out)
    digest = tables.file_digests(made.sparkSession, f"{path}/*.csv").first()
    tables.write_notes(f"{out}.notes.md", "Generated rows", facts | {"rows": made.count(), "file": digest.name, "sha256": digest.sha256, "errors": "; ".join(errors) or None})
    return errors


def run(spark: SparkSession, source: str, config: dict, out: str | None = None) -> dict[str, list[str]]:
    """Trains and generates for every model; gives each one's errors."""
    real, schema = _load(spark, source)
    out = out or tables.run_folder(config.get("output_dir", "outputs"))
    tables.write_json(schema.to_dict(), f"{out}/schema.json")
    rows = max(schema.row_count, int(schema.row_count * config.get("n_rows_multiplier", 1.0)))
    errors = {}
    for name in model_names(config):
        own = tables.model_config(config, name)
        model = tables.create_model(name, config.get("seed", 42)).fit(real, schema, ROW, own)
        tables.save_model(model, f"{out}/{name}.json")
        made = generate(spark, model, real, schema, _rules(real, schema, own), rows, **_options(own))
        errors[name] = _deliver(made, real, schema, f"{out}/{name}", {"model": name, "seed": model.seed})
    tables.write_json({"errors": errors, "rows": rows}, f"{out}/summary.json")
    return errors


def postprocess(spark: SparkSession, source: str, synthetic: str, out: str, strength: float = STRENGTH, mode: str = "fill_missing_datetime", **options) -> dict:
    """Conditional blanks of a synthetic table brought towards the source's rates, written, checked and noted; ``options`` are
    those of :func:`rules.soft_align`."""
    real, schema = _load(spark, source)
    syn = checkpoint(tables.read_csv(spark, synthetic))
    found = clinical.constraints(real, schema, True, mode)
    adjusted, summary = rules.soft_align(syn, real, found, ROW, strength, **options)
    path, errors = tables.write_validated(adjusted, real, schema, out)
    changed = validate.changes(syn, adjusted, ROW, schema.order).first()
    facts = {"strength": strength, "adjustments": len(summary), "changed cells": changed.cells, "changed rows": changed.rows, "errors": "; ".join(errors) or None}
    tables.write_notes(f"{path}.notes.md", "Post-processed rows", facts, summary)
    return {"errors": errors, "adjustments": summary, "cells": changed.cells, "rows": changed.rows}


def score(real: DataFrame, syn: DataFrame, schema: Schema, constraints: rules.Constraints, order: str = ROW, weights: dict | None = None) -> dict[str, float]:
    """The five parts of the composite score and their weighted sum.  Marginal, dependency and discriminator are defined by us."""
    numeric = [c.name for c in schema.columns if c.kind == "numeric"]
    distance = privacy.summary(privacy.source_distances(real, syn, schema, order))
    joined = distance.crossJoin(privacy.exact_match_rate(syn, real, schema.order)).crossJoin(privacy.duplicate_rate(syn, schema.order))
    parts = {
        "marginal": validate.marginal_score(real.select([col(c) for c in schema.order]), syn),
        "dependency": validate.dependency_score(real, syn, numeric),
        "discriminator": validate.discriminator_score(real, syn, numeric),
        "privacy": joined.select(privacy.privacy_score(F.col("exact_match_rate"), F.col("duplicate_rate"), F.col("median_distance"))).first()[0],
        "logic": rules.logic_score(syn, constraints).first()[0],
    }
    return parts | {"total": validate.total_score(parts, weights)}


def precheck(spark: SparkSession, source: str, synthetic: str, config: dict | None = None, quick: bool = False) -> dict:
    """Format, similarity of columns and plausibility; unless ``quick`` or columns differ, the score as well."""
    real, schema = _load(spark, source)
    syn = checkpoint(tables.read_csv(spark, synthetic))
    errors = validate.check_format(real.drop(ROW), syn.drop(ROW))
    similar = {r.name: r.similarity for r in validate.ks_similarity(validate.numeric_pairs(real.drop(ROW), syn.drop(ROW))).collect()}
    report = {"errors": errors, "similarity": similar, "sanity": validate.sanity(syn)}
    if not quick and set(schema.order) <= set(syn.columns):
        report["score"] = score(real, syn, schema, _rules(real, schema, config or {}), weights=(config or {}).get("score_weights"))
    return report


def main(args: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabloom", description="Profile, synthesize, repair and check tables.")
    parser.add_argument("command", choices=["run", "train", "generate", "postprocess", "check"])
    parser.add_argument("--config", help="JSON or YAML file")
    parser.add_argument("--override", help="a second file whose values win")
    parser.add_argument("--source", required=True)
    parser.add_argument("--synthetic")
    parser.add_argument("--artifact")
    parser.add_argument("--out", default="outputs")
    parser.add_argument("--rows", type=int)
    parser.add_argument("--seed", type=int)
    parser.add_argument("--strength", type=float, default=STRENGTH)
    parser.add_argument("--min-excess-rate", type=float, default=0.05, help="post-process only children whose rate exceeds the real one by more")
    parser.add_argument("--derived-repair-mode", default="fill_missing_datetime")
    for what in ("parent", "child"):
        for verb in ("include", "exclude"):
            parser.add_argument(f"--{verb}-{what}-pattern", action="append", default=[], help="part of a column's name; may be repeated")
    parser.add_argument("--max-blanks-per-rule", type=int)
    parser.add_argument("--quick", action="store_true")
    got = parser.parse_args(args)
    config = tables.read_config(got.config) if got.config else {}
    config = tables.merged(config, tables.read_config(got.override)) if got.override else config
    spark = session()
    if got.command == "run":
        return int(any(run(spark, got.source, config, got.out).values()))
    if got.command == "train":
        print(train(spark, got.source, config, got.out))
        return 0
    if got.command == "generate":
        return int(bool(generate_from(spark, got.source, got.artifact, config, got.out, got.rows, got.seed)))
    if got.command == "postprocess":
        options = {
            "least_excess": got.min_excess_rate, "include": got.include_parent_pattern, "exclude": got.exclude_parent_pattern,
            "include_children": got.include_child_pattern, "exclude_children": got.exclude_child_pattern, "most": got.max_blanks_per_rule,
        }
        return int(bool(postprocess(spark, got.source, got.synthetic, got.out, got.strength, got.derived_repair_mode, **options)["errors"]))
    report = precheck(spark, got.source, got.synthetic, config, got.quick)
    tables.write_json(report, str(Path(got.out) / "precheck.json"))
    print(report)
    return int(bool(report["errors"]))


if __name__ == "__main__":
    sys.exit(main())
