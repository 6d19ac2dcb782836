"""CSV sources and sinks, configuration, reports, notes and model artifacts.

A CSV is read as text with every spelling of a missing cell made null; ``_row_id`` is the row's place in the file order
(dense for one file; files in path order).  Files on the driver are only small reports and configuration.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.scalars import col, is_number, na_to_null, to_double
from tabloom.operators import conform as conforming
from tabloom.operators import validate
from tabloom.operators.baseline import IndependentBaseline
from tabloom.operators.copula import GaussianCopula
from tabloom.operators.profile import Schema

ROW = "_row_id"


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """The file with ``_row_id``; columns whose cells all spell numbers are doubles unless ``infer`` is off."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "").csv(path)
    names = raw.columns
    numbered = raw.rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in names], T.StructField(ROW, T.LongType())])
    df = spark.createDataFrame(numbered, schema).select(ROW, *[na_to_null(col(c)).alias(c) for c in names])
    if not infer or not names:
        return df
    whole = df.agg(*[F.bool_and(is_number(col(c)) | col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)], *[F.count(col(c)).alias(f"k{i}") for i, c in enumerate(names)]).first()
    return df.select(ROW, *[to_double(col(c)).alias(c) if whole[f"n{i}"] and whole[f"k{i}"] else col(c) for i, c in enumerate(names)])


def write_csv(df: DataFrame, path: str, order: str | None = ROW) -> str:
    """One file with a header, rows in order, under the folder ``path``."""
    if order and order in df.columns:
        df = df.orderBy(col(order)).drop(order)
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_validated(df: DataFrame, real: DataFrame, schema: Schema, path: str, order: str = ROW) -> tuple[str, list[str]]:
    """Conformed, written, read again and checked; gives the path and the errors."""
    write_csv(conforming.conform(df, real, schema, order), path, order)
    again = read_csv(df.sparkSession, path).drop(ROW)
    return path, validate.check_format(real.select([col(c) for c in schema.order]), again, early=False)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("sha256"))


def read_config(path: str) -> dict:
    """A JSON or YAML file; other kinds are an error."""
    kind = Path(path).suffix.lower()
    text = Path(path).read_text(encoding="utf-8")
    if kind == ".json":
        return json.loads(text)
    if kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError:
            return _plain_yaml(text)
        return yaml.safe_load(text) or {}
    raise ValueError(f"Unsupported config format: {kind}")


def _plain_yaml(text: str) -> dict:
    """Nested maps, lists of scalars and scalars: what configurations use, where no YAML library is installed."""
    top: dict = {}
    stack: list[tuple[int, dict]] = [(-1, top)]
    last: tuple[dict, str] | None = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth, bare = len(bare) - len(bare.lstrip()), bare.strip()
        if bare.startswith("- ") and last:
            holder, key = last
            if not isinstance(holder[key], list):
                holder[key] = []
            holder[key].append(_scalar(bare[2:]))
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        key, _, value = bare.partition(":")
        holder = stack[-1][1]
        if value.strip():
            holder[key] = _scalar(value.strip())
        else:
            holder[key] = {}
            stack.append((depth, holder[key]))
        last = (holder, key)
    return top


def _scalar(text: str) -> object:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")


def merged(base: dict, over: dict) -> dict:
    """Deeply merged; the second wins."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def model_config(config: dict, name: str) -> dict:
    """The run's configuration with the model's own section over it."""
    return merged(config, config.get(name) or {})


def write_json(data: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, default=str, ensure_ascii=False), encoding="utf-8")


def write_markdown(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def write_notes(path: str, title: str, facts: dict[str, object], adjustments: Sequence[dict] = ()) -> str:
    """A list of labels and values beside an output; values of None are left out; at most 15 adjustments."""
    lines = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items() if v is not None]]
    if adjustments:
        most = sorted(adjustments, key=lambda a: -a["blanked_rows"])[:15]
        lines += ["", "## Largest adjustments", "", *[f"- {a['parent']} -> {a['child']}: {a['blanked_rows']} rows" for a in most]]
    write_markdown("\n".join(lines) + "\n", path)
    return path


def run_folder(base: str) -> str:
    path = Path(base) / datetime.now().strftime("%Y%m%d_%H%M%S")
    path.mkdir(parents=True, exist_ok=True)
    return str(path)


def save_model(model: GaussianCopula | IndependentBaseline, path: str) -> None:
    """A fitted model as JSON: no code is stored, and any version can read it.  A baseline's cells are a table beside it."""
    write_json(model.to_dict(), path)
    if isinstance(model, IndependentBaseline):
        model.df.select([col(c) for c in dict.fromkeys([model.order, *model.schema.order])]).write.mode("overwrite").parquet(f"{path}.cells")


def load_model(path: str) -> GaussianCopula | IndependentBaseline:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if data.get("model") == IndependentBaseline.name:
        return IndependentBaseline.from_dict(data, SparkSession.active().read.parquet(f"{path}.cells"))
    if data.get("model") != GaussianCopula.name:
        raise ValueError(f"Not a stored model: {path}")
    return GaussianCopula.from_dict(data)


MODELS = {"copula": GaussianCopula, "gaussian_copula": GaussianCopula, "baseline": IndependentBaseline, "independent_baseline": IndependentBaseline}


def create_model(name: str, seed: int = 42) -> GaussianCopula | IndependentBaseline:
    if name not in MODELS:
        raise KeyError(f"Unknown model {name}; there are {sorted(MODELS)}")
    return MODELS[name](seed)
