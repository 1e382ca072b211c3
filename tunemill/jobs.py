"""State of a long job: finished phases, the run's id, and the final report.

With a session, paths are of the file system that the cluster shares, so that a driver which starts again elsewhere knows
what was finished; without one, of the machine's own."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from tunemill.sources.readers import read_text, replace_text


def load_state(path: str | Path, spark: SparkSession | None = None) -> dict:
    """The saved state; empty if there is none."""
    if spark:  # where a crash came between the two steps of a save, the new one is all there is
        text = read_text(spark, str(path)) or read_text(spark, f"{path}.new")
        return json.loads(text) if text else {}
    path = Path(path)
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}


def save_state(state: dict, path: str | Path, spark: SparkSession | None = None) -> None:
    """Written beside the old one and put in its place, so that a crash leaves one of the two. Other types become text."""
    text = json.dumps(state, indent=2, default=str)
    if spark:
        return replace_text(spark, str(path), text)
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(f"{path.name}.new")
    new.write_text(text, encoding="utf-8")
    new.replace(path)


def run_phases(phases: dict[str, Callable[[dict], dict]], path: str | Path, spark: SparkSession | None = None) -> dict:
    """Runs each phase that the saved state does not name as completed; what it returns joins the state, which is saved
    after each. A job that is started again goes on with the first open phase."""
    state = load_state(path, spark)
    for name, phase in phases.items():
        if name not in state.setdefault("completed_phases", []):
            state |= phase(state) or {}
            state["completed_phases"].append(name)
            save_state(state, path, spark)
    return state


def report(state: dict, path: str | Path, spark: SparkSession | None = None, **given: object) -> dict:
    """The results of the state, and what is given, as the job's report in JSON."""
    out = {"best_lr": state.get("best_lr"), "recommended_config": state.get("recommended", {}), **{k: state.get(k, []) for k in ("sweep_results", "ablation_results")}, **given}
    save_state(out, path, spark)
    return out


def will_resume(resume_from: str, latest: str | None) -> bool:
    """Whether a run goes on from a checkpoint: from a named one always, with "auto" only if there is one."""
    return bool(resume_from) and (resume_from != "auto" or latest is not None)


def run_id(folder: str | Path, name: str, reuse: bool, spark: SparkSession | None = None) -> str:
    """The id that a run logs under, kept in its folder. A resumed run keeps the id; any other gets a new one."""
    path = f"{folder}/run_id.json"
    if reuse:
        try:
            known = load_state(path, spark).get("id")
        except ValueError:
            known = None
        if known:
            return known
    new = secrets.token_hex(8)
    save_state({"id": new, "name": name}, path, spark)
    return new
