"""Steps of a run that need each other, with reasons for those that were left out, and a limit of time."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Run:
    """What came of a run: results by step, and why steps are missing, in order."""

    results: dict[str, Any] = field(default_factory=dict)
    missing: dict[str, str] = field(default_factory=dict)

    @property
    def missing_steps(self) -> list[str]:
        return list(self.missing)


def run_steps(steps: list[tuple[str, list[str], Callable[..., Any]]], seen: Callable[[str, Run], None] = lambda name, run: None) -> Run:
    """Runs steps (name, needed steps, function of their results) in order. A step whose need is missing is left out; one that fails is
    missing with its error; the others go on. Results are lazy frames as a rule, so nothing is computed twice that Spark can share."""
    run = Run()
    for name, needs, work in steps:
        lacking = [n for n in needs if n not in run.results]
        if lacking:
            run.missing[name] = "needs " + ", ".join(lacking)
        else:
            try:
                run.results[name] = work(*[run.results[n] for n in needs])
            except Exception as e:  # noqa: BLE001 - the reason is kept
                run.missing[name] = f"{type(e).__name__}: {e}"
        seen(name, run)
    return run


def within(spark: SparkSession, seconds: float, work: Callable[[], Any]) -> Any:
    """The result of `work`; its Spark jobs are cancelled and TimeoutError raised once `seconds` have gone."""
    tag, out = f"within-{threading.get_ident()}-{id(work)}", {}

    def go() -> None:
        spark.addTag(tag)
        try:
            out["value"] = work()
        except Exception as e:  # noqa: BLE001 - raised below, in the caller
            out["error"] = e

    t = threading.Thread(target=go, daemon=True)
    t.start()
    t.join(seconds)
    if t.is_alive():
        spark.interruptTag(tag)
        raise TimeoutError(f"not done within {seconds} s")
    if "error" in out:
        raise out["error"]
    return out["value"]
