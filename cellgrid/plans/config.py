"""Layered configuration: defaults, then the user's file, the build's, and the subset's own."""

from __future__ import annotations

import copy
import os
from pathlib import Path

import yaml

# The defaults that results depend on.
DEFAULTS = {
    "paths": {"build": "", "samples": "", "autoannotation": "", "metadata": ""},
    "params": {
        "batch_keys": [], "k": 25, "k_pooling": 10, "factorization": "PCA", "min_umis": 1000, "n_factors": 50, "n_genes": 2000, "nn_space": "auto", "mask": ["cellcycle", "sex", "ieg", "mt"],
        "features": "enrichment", "clusterer": "louvain", "graph": "RNN", "passedQC": False, "doublets_action": "remove", "min_fraction_good_cells": 0.4, "max_fraction_MT_genes": 1,
        "min_fraction_unspliced_reads": 0.1, "doublets_method": "scrublet", "max_doubletFinder_th": 0.4, "skip_missing_samples": False, "skip_metadata": False,
    },
    "steps": ["poisson_pooling", "nn", "embeddings", "clustering", "aggregate", "export"],
    "execution": {"engine": "local", "n_cpus": 0, "n_gpus": 0, "memory": 128, "dryrun": True},
}


def merged(base: dict, over: dict, path: str = "") -> dict:
    """``over`` on top of ``base``; a key that the base doesn't have is an error."""
    out = copy.deepcopy(base)
    for key, value in (over or {}).items():
        if key not in out:
            raise KeyError(f"no setting {path}{key}")
        out[key] = merged(out[key], value, f"{path}{key}.") if isinstance(out[key], dict) and isinstance(value, dict) else value
    return out


def load_config(build: str | None = None, subset=None, home: str | None = None) -> dict:
    config = DEFAULTS
    for folder in (home or os.path.expanduser("~"), build):
        for name in (".cellgrid", "config.yaml"):
            path = Path(folder, name) if folder else None
            if path and path.is_file():
                config = merged(config, yaml.safe_load(path.read_text()) or {})
    return with_subset(config, subset)


def with_subset(config: dict, subset) -> dict:
    """A configuration with a subset's own parameters, execution and steps on top."""
    if subset is None:
        return config
    own = {"params": subset.params, "execution": subset.execution}
    config = merged(config, {k: v for k, v in own.items() if v})
    return {**config, "steps": list(subset.steps)} if subset.steps else config


def flat(config: dict, path: str = "") -> list[tuple[str, str]]:
    """(name, value) of every setting, nested names joined by dots, values as YAML."""
    out = []
    for key, value in config.items():
        out += flat(value, f"{path}{key}.") if isinstance(value, dict) else [(f"{path}{key}", yaml.safe_dump(value, default_flow_style=True).split("\n...")[0].strip())]
    return out
