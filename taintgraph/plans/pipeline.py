"""Running steps in order: timed, logged, skipped when their output is there, going on after a failure."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from taintgraph.operators import audits, build, models, splits
from taintgraph.sources import sinks


@dataclass
class Status:
    """What happened to each step; ``todo`` lists what is left after failures."""

    rows: list[dict] = field(default_factory=list)

    @property
    def todo(self) -> list[str]:
        return [r["task"] for r in self.rows if not r["ok"]]

    def markdown(self) -> str:
        line = [f"| {r['task']} | {'skipped' if r['skipped'] else 'ok' if r['ok'] else 'failed'} | {r['seconds']:.1f} | {r['error'] or ''} |" for r in self.rows]
        return "\n".join(["| task | state | seconds | error |", "| --- | --- | --- | --- |", *line, *[f"- TODO: {t}" for t in self.todo]])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_task(status: Status, name: str, task: Callable[[], object], output: str | None = None, spark: SparkSession | None = None) -> bool:
    """Run one step; False when it failed. A step whose output is complete is skipped."""
    began, error, skipped = time.time(), None, bool(output and spark and exists(spark, output))
    if not skipped:
        try:
            task()
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]
            traceback.print_exc()
    status.rows.append({"task": name, "ok": error is None, "skipped": skipped, "seconds": time.time() - began, "error": error})
    return error is None


def run_all(tasks: Iterable[tuple[str, Callable[[], object], str | None]], spark: SparkSession) -> tuple[Status, int]:
    """All steps in order, whatever fails; the exit code says whether all went well."""
    status = Status()
    for name, task, output in tasks:
        run_task(status, name, task, output, spark)
    return status, int(bool(status.todo))


def run_waves(waves: Iterable[list[tuple[str, Callable[[], object], str | None]]], spark: SparkSession, at_once: int = 4) -> tuple[Status, int]:
    """Waves of steps: the steps of a wave run side by side on the one session, whose scheduler shares the executors among
    them; a wave begins when the one before has ended. A failing step stops nothing."""
    from concurrent.futures import ThreadPoolExecutor

    status = Status()
    for wave in waves:
        with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(wave)))) as pool:
            list(pool.map(lambda t: run_task(status, t[0], t[1], t[2], spark), wave))
    return status, int(bool(status.todo))


def sweep_corpora(spark: SparkSession, contexts: dict[str, splits.SplitContext], waves: list[list[str]], out: str, configs: list[tuple[str, dict]] = splits.SWEEP) -> tuple[Status, int]:
    """Build and store every configuration's split for every corpus, corpora in waves: ``out/corpus/protocol__params__seedN``.
    What is stored already is skipped."""

    def one(corpus: str, name: str, params: dict, path: str) -> Callable[[], None]:
        def task() -> None:
            splits.build_split(name, contexts[corpus], **params).write.mode("overwrite").parquet(path)

        return task

    def tasks(corpus: str) -> list[tuple[str, Callable[[], object], str | None]]:
        paths = [(n, p, f"{out}/{corpus}/{splits.stored_name(n, splits.param_string(p), contexts[corpus].seed)}") for n, p in configs]
        return [(f"{corpus}/{path.rsplit('/', 1)[1]}", one(corpus, n, p, path), path) for n, p, path in paths]

    return run_waves([[t for c in wave for t in tasks(c)] for wave in waves], spark)


def build_graph(spark: SparkSession, raw_nodes: DataFrame, raw_edges: DataFrame, out: str, clusters: DataFrame | None = None) -> tuple[Status, int]:
    """Raw to canonical graph on disk: nodes, edges by type, size report; invariants are checked on what was written."""

    def consolidate() -> None:
        n, e = build.consolidate(raw_nodes, raw_edges, clusters)
        n.write.mode("overwrite").parquet(f"{out}/nodes")
        sinks.write_edges(e, f"{out}/edges")

    def check() -> None:
        build.assert_invariants(spark.read.parquet(f"{out}/nodes"), spark.read.parquet(f"{out}/edges"))

    def report() -> None:
        sinks.write_csv(sinks.stats_table(spark.read.parquet(f"{out}/nodes"), spark.read.parquet(f"{out}/edges")), f"{out}/stats")

    return run_all([("consolidate", consolidate, f"{out}/edges"), ("invariants", check, None), ("stats", report, f"{out}/stats")], spark)


def train_all_splits(spark: SparkSession, ctx: splits.SplitContext, texts: DataFrame, out: str, configs: list[tuple[str, dict]], model: str = "rf") -> tuple[Status, int]:
    """Split, audit, and where the audit says the test fold is large enough, train and store scores."""

    def one(name: str, params: dict, path: str) -> Callable[[], None]:
        def task() -> None:
            split = splits.build_split(name, ctx, **params)
            if not splits.audit_split(split, ctx.examples, ctx.edges).first()["feasible"]:
                raise ValueError("the test fold is too small")
            rows = split.join(ctx.examples.select("node_id", "label"), "node_id").join(texts, "node_id")
            models.score(rows, model).write.mode("overwrite").parquet(path)

        return task

    tasks = []
    for name, params in configs:
        path = f"{out}/{name}_{splits.param_string(params)}"
        tasks.append((path.rsplit("/", 1)[1], one(name, params, path), path))
    return run_all(tasks, spark)


def score_report(scores: dict[str, DataFrame], source: DataFrame) -> DataFrame:
    """AUROC per split and source over stored scores, and the change against the split called ``random_default``."""
    out = None
    for key, df in scores.items():
        p = df.join(source, "node_id").selectExpr("node_id as example_id", "source", "label", "fold", "score", f"'{key}' as protocol")
        out = p if out is None else out.unionByName(p)
    return audits.auroc_all_splits(out, base="random_default")
