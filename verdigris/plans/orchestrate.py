"""The gate from changed files to an outcome: every early end is an outcome of its own, and any failure is reported as an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import pairing
from verdigris.operators import statistics as st
from verdigris.plans import gate
from verdigris.sources.files import ResultCache, cache_key


def run_gate(
    request: dict,
    certificate: dict | None,
    cert_inputs: dict,
    cache: ResultCache,
    make_base: Callable[[], DataFrame],
    make_candidate: Callable[[], DataFrame],
    tags: DataFrame,
    cap: float = 4.0,
    resamples: int = 10_000,
    seed: int = 20260930,
) -> dict:
    """request: changed (paths), fork, head_sha, run_id, reason, prior (parsed marker), key_parts. Returns outcome, exit code, report and figures."""

    def ended(outcome: str, **more) -> dict:
        return {"outcome": outcome, "exit": gate.EXIT.get(outcome, 0)} | more

    try:
        if request.get("fork"):
            return ended("error", message="changes from forks are not run")
        if not gate.is_gated(request["changed"]):
            return ended("not_applicable")
        if stale := gate.stale_inputs(certificate, cert_inputs):
            return ended("error", message="the judge's certificate is stale: " + ", ".join(stale))
        if gate.rerun_action(request.get("prior"), request["head_sha"], request.get("reason", "")) == "replay":
            return ended("block", replayed=True)
        key = cache_key(request["key_parts"])
        base = cache.get(key)
        hit = base is not None
        if not hit:
            cache.put(key, make_base())
            base = cache.get(key)
        cost = base.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("c")).first()["c"]
        spent = 0.0 if hit else cost
        if gate.too_dear(cost, spent, cap):
            return ended("error", message=f"a candidate run may cost {cost * 1.2:.2f}, with {spent:.2f} of {cap:.2f} spent")
        cand = make_candidate().cache()
        wrong = max(pairing.judge_error_fraction(r.select(F.col("scores.judge_error").alias("judge_error"))).first()["fraction"] for r in (base, cand))
        if message := gate.error_outcome(wrong):
            return ended("error", message=message)
        result = gate.compare(base, cand, resamples, seed)
        pairs = pairing.paired(base, cand)
        by_tag = [r.asDict() for r in st.per_tag(pairing.tag_deltas(pairs, tags), resamples, seed).orderBy("tag").collect()]  # a row a tag
        worst = [r.asDict() for r in pairing.worst(pairs, 5, cand.select("task_id", "repeat", "success", "trace_id")).orderBy("d", "task_id").collect()]
        facts = {"Cost of the base": f"{cost:.2f} USD{' (from the cache)' if hit else ''}", "Judge errors": f"{wrong:.1%} of rows"} | {f"Hash of {k}": v for k, v in cert_inputs.items()}
        report = gate.render(result, by_tag, worst, request | {"certificate": certificate, "facts": facts})
        return ended(result["verdict"], report=report, result=result, tags=by_tag, worst=worst, cache_hit=hit)
    except Exception as error:  # noqa: BLE001  a gate that fails says so instead of passing
        return ended("error", message=f"{type(error).__name__}: {error}")


def equal_sides(runs: list[tuple[DataFrame, DataFrame]], resamples: int, seed: int) -> dict:
    """Share of blocks among comparisons of runs that should not differ."""
    verdicts = [gate.compare(a, b, resamples, seed)["verdict"] for a, b in runs]
    rate = sum(v == "block" for v in verdicts) / len(verdicts) if verdicts else float("nan")
    return {"runs": len(verdicts), "rate": rate, "passed": bool(rate <= 0.05), "verdicts": verdicts}
