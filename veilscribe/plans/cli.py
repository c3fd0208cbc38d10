"""``python -m veilscribe.plans.cli STAGE --config FILE``: one stage as a Spark application.

Models are named as ``module:maker`` in the configuration's ``plugins``: ``engine`` for
recognition, ``model`` for detection.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from veilscribe.plans import stages
from veilscribe.sources.files import read_yaml

STAGES = {
    "asr": stages.run_asr, "pii": stages.run_pii, "mask": stages.run_mask, "eval": stages.run_eval, "asr-eval": stages.run_asr_eval, "pii-eval": stages.run_pii_eval, "pii-eval-gold": stages.run_pii_eval_gold,
}
PLUGINS = {"asr": ("engine", True), "pii": ("model", False), "pii-eval": ("model", True), "pii-eval-gold": ("model", False)}


def _plugin(name: str):
    module, _, maker = name.partition(":")
    return getattr(importlib.import_module(module), maker)


def main(args: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="veilscribe")
    parser.add_argument("stage", choices=sorted(STAGES))
    parser.add_argument("--config", required=True)
    parser.add_argument("--root", default="data/runs")
    given = parser.parse_args(args)
    config = read_yaml(given.config)
    more = []
    if given.stage in PLUGINS:
        kind, needed = PLUGINS[given.stage]
        name = config.get("plugins", {}).get(kind)
        if needed and not name:
            parser.error(f"{given.stage} needs plugins.{kind}")
        more = [_plugin(name)] if name else []
    spark = SparkSession.builder.appName(f"veilscribe-{given.stage}").getOrCreate()
    out = STAGES[given.stage](spark, config, given.root, *more)
    print(out)
    return out


if __name__ == "__main__":
    main()
