"""Command line over the run plans: ``python -m stratafuse.plans.cli <group> <command> ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException, PythonException

from stratafuse.plans import artifacts as A
from stratafuse.plans import evaluation, previews, student
from stratafuse.session import spark_session
from stratafuse.sources import folders


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratafuse")
    groups = p.add_subparsers(dest="group")

    def command(group, name: str, *args: str, flags: tuple[str, ...] = (), options: dict | None = None):
        c = group.add_parser(name)
        for a in args:
            c.add_argument(a)
        for f in flags:
            c.add_argument(f, action="store_true")
        for o, kind in (options or {}).items():
            c.add_argument(o, type=kind)

    smoke = groups.add_parser("smoke").add_subparsers(dest="command")
    command(smoke, "synthetic-cube-room", "output")
    command(smoke, "tsdf-cube-room", "output", flags=("--mesh", "--world-map"))
    command(smoke, "teacher-cache-tsdf", "cache", "output", flags=("--mesh", "--world-map"))
    command(smoke, "runtime-fixture", "output")
    command(smoke, "checkpoint-tsdf", "checkpoint", "output", options={"--input": str, "--width": int, "--height": int, "--seed": int, "--voxel-size-m": float, "--truncation-voxels": float})
    training = groups.add_parser("train").add_subparsers(dest="command")
    command(training, "synthetic-overfit", "output", options={"--steps": int, "--batch-size": int, "--num-samples": int, "--width": int, "--height": int, "--seed": int, "--learning-rate": float, "--log-every": int})
    preview = groups.add_parser("preview").add_subparsers(dest="command")
    command(preview, "session", "input", "output")
    export = groups.add_parser("export").add_subparsers(dest="command")
    for name in ("session", "tsdf-output"):
        command(export, name, "input", "output")
    inspect = groups.add_parser("inspect").add_subparsers(dest="command")
    for name in ("session", "teacher-cache", "runtime-fixture", "world-map"):
        command(inspect, name, "input")
    command(inspect, "tsdf-output", "input", options={"--mode": str})
    evaluate = groups.add_parser("eval").add_subparsers(dest="command")
    for name in evaluation.PARTS:
        command(evaluate, name, "run_dir", options={f"--{o}": str for o in ("input", "truth", "dataset", "split", "checkpoint", "commit", "scale-source", "by", "memory")} | {"--cell": float, "--voxel": float})
    command(evaluate, "report", "run_dir")
    adapters = groups.add_parser("adapters").add_subparsers(dest="command")
    command(adapters, "list")
    command(adapters, "run", "name", "session", "cache", flags=("--summaries-only",))
    return p


def main(argv: list[str] | None = None) -> int:
    """0 on success and without a command; 2 for input that fails its checks."""
    a = parser().parse_args(argv)
    if not getattr(a, "command", None):
        return 0
    spark = spark_session()
    try:
        out = _run(spark, a)
    except (AnalysisException, KeyError, NotImplementedError, PythonException, ValueError) as e:  # a missing table, an unknown name, a faulty file
        print(str(e).partition("\nJVM stacktrace")[0], file=sys.stderr)
        return 2
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, sort_keys=True))
    return 0


def _run(spark, a):
    match a.group, a.command:
        case "smoke", "synthetic-cube-room":
            return A.write_session(spark, a.output)
        case "smoke", "tsdf-cube-room":
            A.write_session(spark, f"{a.output}/session")
            A.run_adapter(spark, "fixture-cube-room", f"{a.output}/session", f"{a.output}/cache")
            return A.replay_cache(spark, f"{a.output}/cache", a.output, mesh=a.mesh, world_map=a.world_map)
        case "smoke", "teacher-cache-tsdf":
            return A.replay_cache(spark, a.cache, a.output, mesh=a.mesh, world_map=a.world_map)
        case "smoke", "runtime-fixture":
            return A.run_fixture(spark, a.output)
        case "smoke", "checkpoint-tsdf":
            given = {"input_clip": a.input, "width": a.width, "height": a.height, "seed": a.seed, "voxel": a.voxel_size_m, "truncation_voxels": a.truncation_voxels}
            return student.checkpoint_fusion(spark, a.checkpoint, a.output, **{k: v for k, v in given.items() if v is not None})
        case "train", "synthetic-overfit":
            names = ("steps", "batch_size", "num_samples", "width", "height", "seed", "learning_rate", "log_every")
            return student.train(spark, a.output, student.Config(**{n: getattr(a, n) for n in names if getattr(a, n) is not None}))
        case "preview", "session":
            return {"written": previews.write_session_preview(spark, A.load_session(spark, a.input), a.output)}
        case "export", "session":
            return folders.write_session(spark, A.load_session(spark, a.input), a.output)
        case "export", "tsdf-output":
            return {"written": folders.write_fusion(spark, a.input, a.output)}
        case "inspect", "session":
            return A.load_session(spark, a.input)["metadata"]
        case "inspect", "teacher-cache":
            return A.inspect_cache(spark, a.input)
        case "inspect", "tsdf-output":
            return A.inspect_output(spark, a.input, mode=a.mode or "complete")
        case "inspect", "world-map":
            return A.world_map_report(spark, a.input)
        case "inspect", "runtime-fixture":
            return A.inspect_run(spark, a.input)
        case "eval", "report":
            return evaluation.report(a.run_dir)
        case "eval", part:
            return evaluation.run(spark, part, a.run_dir, vars(a))
        case "adapters", "list":
            return "\n".join(f"{n}\t{A.adapter_status(n)}" for n in A.ADAPTERS)
        case _:
            return A.run_adapter(spark, a.name, a.session, a.cache, not a.summaries_only)


if __name__ == "__main__":
    sys.exit(main())
