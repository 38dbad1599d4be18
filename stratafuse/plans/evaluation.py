"""Evaluation runs: metrics of poses, depth, surfaces, objects and run times as records of a folder, and the report over them.

Each part reads stored tables (Parquet), aggregates them where they are, and writes a small record with what it was measured on. The report
states nothing that no record holds, and warns where a claim would need more than the records say.
"""

from __future__ import annotations

import platform
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.operators import detections as X
from stratafuse.operators import distances as D
from stratafuse.operators import summaries as M
from stratafuse.operators import trajectories as T
from stratafuse.session import discard, stored
from stratafuse.sources import texts

PARTS = ("pose", "depth", "mesh", "objects", "runtime")
#: Rows of a record's table (tracks, thresholds, labels); a part of more keeps those of the largest error and says so.
MOST_ROWS = 1000
#: Metres; claims at a threshold need a voxel no larger than it.
THRESHOLDS = (0.001, 0.005, 0.01, 0.05)


def _rows(df: DataFrame, worst: str) -> tuple[list[dict], list[str]]:
    rows = [r.asDict() for r in df.orderBy(F.desc_nulls_last(worst)).limit(MOST_ROWS + 1).collect()]
    return rows[:MOST_ROWS], [f"only the {MOST_ROWS} rows of highest {worst} are listed"] if len(rows) > MOST_ROWS else []


def eval_pose(poses: DataFrame, metric: bool = True, step: int = 1) -> dict:
    """Aligned errors of tracks (track, order, ex..ez, px..pz), without scale for metric tracks, with it for others; relative errors over ``step`` poses
    and drift a metre; ``lost`` counts poses without an estimate."""
    lost = poses.where(" or ".join(f"e{c} is null" for c in "xyz")).count()
    errors = stored(T.aligned_errors(poses, not metric))
    tracks, warnings = _rows(errors, "rmse_m")
    whole = errors.agg(F.count("*"), F.sqrt(F.sum(F.col("rmse_m") * F.col("rmse_m") * F.col("n_poses")) / F.sum("n_poses")), F.count_if(F.col("rank") < 2)).first()
    discard(errors)
    steps = M.relative_errors(poses.dropna(subset=[f"{s}{c}" for s in "ep" for c in "xyz"]), "track", "order", ("ex", "ey", "ez"), ("px", "py", "pz"), step)
    totals = steps.agg(*[F.avg(c).alias(c) for c in steps.columns if c not in ("track", "order", "n")]).first()
    warnings += [f"{lost} poses have no estimate"] * (lost > 0) + [f"{whole[2]} tracks lie on a line, so their turn is not unique"] * (whole[2] > 0)
    return {"metrics": {"tracks": whole[0], "ate_rmse_m": whole[1], "alignment": "se3" if metric else "sim3", "lost": lost, **{f"mean_{k}": v for k, v in totals.asDict().items()}}, "table": tracks, "warnings": warnings}


def eval_depth(px: DataFrame, predicted: str = "predicted", target: str = "target", by: str | None = None) -> dict:
    """Depth errors, all together and by a column."""
    whole = M.depth_errors(px, predicted, target).first()
    rows, warnings = _rows(M.depth_errors(px, predicted, target, [by]), "rmse") if by else ([], [])
    if whole is None or not whole["n"]:
        warnings.append("no pixel has a predicted and a true depth")
    return {"metrics": whole.asDict() if whole else {}, "table": rows, "warnings": warnings}


def eval_mesh(found: DataFrame, truth: DataFrame, cell: float, voxel: float, scale_source: str, thresholds: Sequence[float] = THRESHOLDS) -> dict:
    """Distances of surface points both ways (id, x, y, z); thresholds below the voxel are warned of, and so is any metric scale that wasn't measured."""
    rows = [r.asDict() for r in D.surface_metrics(found, truth, tuple(thresholds), cell).orderBy("threshold_m").collect()]  # a row a threshold
    warnings = [f"threshold {t:g} m is below the voxel of {voxel:g} m" for t in thresholds if t < voxel]
    if scale_source not in ("known_anchor", "depth_sensor", "metric_prior"):
        warnings.append(f"scale_source {scale_source}: distances are not measured metres")
    first = rows[0] if rows else {}
    return {"metrics": {k: first.get(k) for k in ("n_found", "n_truth", "accuracy_m", "completeness_m", "chamfer_m")}, "table": rows, "warnings": warnings}


def eval_objects(truths: DataFrame, guesses: DataFrame, least_iou: float = 0.25, cell: float = 2.0) -> dict:
    """Average precision by label of boxes (id, frame_id, label, BOX; guesses with confidence), and its mean."""
    found = X.matches(X.pairs_3d(truths, guesses, cell), guesses, least_iou)
    rows, warnings = _rows(X.average_precision(guesses, truths, found), "ap")
    return {"metrics": {"map": sum(r["ap"] for r in rows) / len(rows) if rows else None, "labels": len(rows), "least_iou": least_iou}, "table": rows, "warnings": warnings}


def eval_runtime(events: DataFrame, value: str = "latency_ms", stage: str = "stage", memory: str | None = None, order: str = "event_index", most_slope: float = 0.0) -> dict:
    """Count and latency percentiles of each stage, and with a memory column its slope over the events."""
    rows, warnings = _rows(M.large_summary(events, value, stage, (0.5, 0.9, 0.99)), "p99")
    metrics: dict = {"events": sum(r["n"] for r in rows)}
    if memory:
        metrics["memory_slope"] = events.agg(F.regr_slope(F.col(memory).cast("double"), F.col(order).cast("double"))).first()[0]
        if metrics["memory_slope"] and metrics["memory_slope"] > most_slope:
            warnings.append(f"{memory} grows by {metrics['memory_slope']:g} an event")
    return {"metrics": metrics, "table": rows, "warnings": warnings}


def write_part(folder: str, part: str, record: dict, provenance: dict) -> None:
    """One record of a run: what was measured, on what, and how."""
    if part not in PARTS:
        raise ValueError(f"part: {part} is none of {', '.join(PARTS)}")
    lacking = [k for k in ("dataset", "split") if not provenance.get(k)]
    if lacking:
        raise ValueError(f"provenance: lacks {', '.join(lacking)}")
    about = {"command": " ".join(sys.argv), "python": platform.python_version(), "machine": platform.machine(), **provenance}
    texts.write_json(f"{folder}/{part}.json", {"part": part, "provenance": about, **record})


def _cell(x) -> str:
    return "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "/")


def report(folder: str) -> str:
    """The run's report.json and report.md over all its parts, as text: provenance, metrics, tables and every warning. ValueError without parts."""
    parts = {p: texts.read_json(f"{folder}/{p}.json") for p in PARTS if texts.is_file(f"{folder}/{p}.json")}
    if not parts:
        raise ValueError(f"{folder}: no evaluation record")
    warnings = [f"{p}: {w}" for p, r in parts.items() for w in r["warnings"]]
    warnings += [f"{p}: {k} is not recorded" for p, r in parts.items() for k in ("checkpoint", "commit") if not r["provenance"].get(k)]
    out = ["# Evaluation", ""]
    for p, r in parts.items():
        out += [f"## {p}", "", *[f"- {k}: {_cell(v)}" for k, v in sorted(r["provenance"].items())], "", "| metric | value |", "| --- | --- |", *[f"| {k} | {_cell(v)} |" for k, v in sorted(r["metrics"].items())], ""]
        if r["table"]:
            names = list(r["table"][0])
            out += ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *["| " + " | ".join(_cell(row.get(n)) for n in names) + " |" for row in r["table"]], ""]
    out += ["## warnings", "", *([f"- {w}" for w in warnings] or ["none"]), ""]
    text = "\n".join(out)
    texts.write_json(f"{folder}/report.json", {"parts": parts, "warnings": warnings})
    texts.write_text(f"{folder}/report.md", text)
    return text


def run(spark: SparkSession, part: str, folder: str, options: dict) -> dict:
    """One part over stored tables, for the command line: ``input`` (and ``truth``) are Parquet folders."""
    table = lambda name: spark.read.parquet(options[name])
    lacking = [n for n in ("input", *(["truth"] if part in ("mesh", "objects") else [])) if not options.get(n)]
    if lacking:
        raise ValueError(f"{part}: needs --{', --'.join(lacking)}")
    match part:
        case "pose":
            record = eval_pose(table("input"), options.get("scale_source", "known_anchor") == "known_anchor")
        case "depth":
            record = eval_depth(table("input"), by=options.get("by"))
        case "mesh":
            record = eval_mesh(table("input"), table("truth"), options.get("cell") or 0.1, options.get("voxel") or 0.1, options.get("scale_source") or "rgb_prior")
        case "objects":
            record = eval_objects(table("truth"), table("input"))
        case "runtime":
            record = eval_runtime(table("input"), memory=options.get("memory"))
        case _:
            raise ValueError(f"part: {part} is none of {', '.join(PARTS)}")
    write_part(folder, part, record, {k: options[k] for k in ("dataset", "split", "checkpoint", "commit", "scale_source") if options.get(k)})
    return record["metrics"]
